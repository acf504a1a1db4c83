"""Local tables served to the paged sources as an address would serve them; for the queries here and for tests."""

from __future__ import annotations


def table_page(url: str, offset: int, limit: int) -> list:
    """Rows of a local Parquet file as a server would page them."""
    import pyarrow.parquet as pq

    return [{k: str(v) for k, v in r.items()} for r in pq.read_table(url).slice(offset, limit).to_pylist()]


def table_count(url: str) -> int:
    import pyarrow.parquet as pq

    return pq.ParquetFile(url).metadata.num_rows


def table_follow(url: str) -> tuple[list, str | None]:
    """Rows of a local Parquet file from an address path#from-to/size, and the address of the next page."""
    path, _, place = url.partition("#")
    span, _, size = place.partition("/")
    a, b = map(int, span.split("-"))
    after = a + int(size)
    return table_page(path, a, min(int(size), b - a)), f"{path}#{after}-{b}/{size}" if after < b else None


def table_ids(url: str, column: str, ids: list) -> list:
    """Records of a local Parquet file whose column has one of the ids; reads the row groups that can have them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    kind = pq.read_schema(url).field(column).type
    wanted = pa.array(ids).cast(kind).to_pylist()
    return [{k: str(v) for k, v in r.items()} for r in pq.read_table(url, filters=[(column, "in", wanted)]).to_pylist()]
