"""Helpers shared by the training-data operators.

Byte work inside tasks is done with numpy over Arrow buffers: a batch of texts is
one ``uint8`` array plus row offsets. Spark does the partitioning and shuffling.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
GOLD = np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes of text worked on at once in a task, unless one text is longer: what is made of them stays in a cache.
PIECE_BYTES = 1 << 17
#: Rows, and bytes of the corpus, for each task that writes a narrow table.
TASK_ROWS, TASK_BYTES = 1 << 17, 32 << 20
#: Paths of the tables stored in the innermost ``stored_tables`` of this thread, if it is in one.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local
    session gets one of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def writers(spark: SparkSession, rows: int = 0, text_bytes: int = 0) -> int:
    """Tasks to write a narrow table with: by its rows, or by the bytes of the texts that it is about."""
    return max(1, min(shuffle_parts(spark), max(-(-rows // TASK_ROWS), -(-text_bytes // TASK_BYTES))))


@contextlib.contextmanager
def stored_tables() -> Iterator[list[str]]:
    """Paths of the tables that this thread stores inside, for ``forget``; those still listed at the end are the outer one's."""
    found: list[str] = []
    token = _TABLES.set(found)
    try:
        yield found
    finally:
        _TABLES.reset(token)
        outer = _TABLES.get()
        if outer is not None:
            outer += found


def stored(df: DataFrame, name: str, parts: int = 0) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it back; its path too.

    ``parts`` tasks write it, or as many as ``df`` has: many rounds over small tables do not
    leave thousands of tiny files, and large ones are written by many tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"
    (df.repartition(parts) if parts else df).write.parquet(path)
    mine = _TABLES.get()
    if mine is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str, parts: int = 0) -> DataFrame:
    """``stored`` without the path."""
    return stored(df, name, parts)[0]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    mine = _TABLES.get()
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if mine is not None and path in mine:
            mine.remove(path)


def small_batches(df: DataFrame) -> None:
    """Arrow batches of this session hold few rows: texts are long, and a batch lies in the memory of both sides."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def digests(df: DataFrame) -> DataFrame:
    """Narrow results of heavy work, exchanged so that fewer tasks write them; the work stays in all tasks."""
    return df.repartition(max(1, shuffle_parts(df.sparkSession) // 6))


def tidied(work):
    """``work`` over a task's Arrow batches, after which the worker gives back the memory that it freed: workers live on."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def same_document(a: DataFrame, b: DataFrame):
    """Join condition on doc_id and text hash, where a null doc_id equals a null one."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def with_text_hash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """Columns doc_id, text (null: empty) and text_hash; rows that agree in all of them are one
    document. With ``rest``, a struct ``rest`` of all columns of ``docs`` but the text, whatever their names."""
    small_batches(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if rest else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *more)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; in a new array."""
    h = h ^ (h >> S33)
    h *= M1
    h ^= h >> S33
    h *= M2
    h ^= h >> S33
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if large else np.int32
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:
        size = np.diff(at)
        empty = ~col.is_valid().to_numpy(zero_copy_only=False)
        if size[empty].any():
            return buffers(col.fill_null("" if "string" in str(col.type) else b""))
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words8(buf: np.ndarray, pad: int = 64) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros follow the end."""
    size = len(buf) + pad - 8
    steps = -(-size // 8)
    padded = np.zeros(8 * steps + 8, np.uint8)
    padded[: len(buf)] = buf
    out = np.empty(8 * steps, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + 8 * steps].view("<u8")
    return out[:size]


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, s[1:] > e[:-1]]
    return s[first], e[np.r_[np.flatnonzero(first)[1:] - 1, len(s) - 1]]


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    with np.errstate(over="ignore"):
        values = mix((np.arange(1, 257, dtype=np.uint64)) * GOLD)
    if lower:
        values[65:91] = values[97:123]
    return values


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end, by differences of one running sum."""
    n = len(buf)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(lower)[buf] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)


def word_spans(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, or of bytes that are not ``outside``, in order; no word crosses a row."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~outside[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, span_hashes(buf, start, end, lower)


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the text as a compressed binary ``z``, and ``rest`` if there: texts on their way through a shuffle."""
    more = ["rest"] if "rest" in docs.columns else []

    def work(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            buf, at = buffers(batch.column(0))
            raw = buf.tobytes()
            z = pa.array([squeeze(raw[at[i] : at[i + 1]]) for i in range(len(batch))], pa.binary())
            yield pa.record_batch([batch.column(1), batch.column(2), z, *batch.columns[3:]], ["doc_id", "text_hash", "z", *more])

    kinds = "".join(f", rest {docs.schema['rest'].dataType.simpleString()}" for _ in more)
    return docs.select("text", "doc_id", "text_hash", *more).mapInArrow(tidied(work), "doc_id long, text_hash long, z binary" + kinds)


def unpacked(col: pa.Array) -> Iterator[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for z in col:
        yield expand(z.as_py())


def bucket_count(spark: SparkSession, total: int, bytes_each: int = 8 << 20) -> int:
    """Buckets for packed exchanges: they grow with the text's ``total`` bytes, so that one bucket stays small."""
    return max(shuffle_parts(spark), -(-total // bytes_each))


def pack_rows(keys: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Structured ``rows`` dealt to buckets by the 64-bit ``keys``: one (bucket, payload) row for each bucket met."""
    if not len(rows):
        return
    bucket = (keys >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order].astype(np.int32), rows[order]
    edge = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    yield pa.record_batch([pa.array(bucket[edge[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["bucket", "payload"])


def unpack_rows(payload: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(p.as_py(), dtype) for p in payload] or [np.zeros(0, dtype)])


def runs(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in sorted columns."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def cut_spans(docs: DataFrame, marks: DataFrame, keep_text: bool = False) -> DataFrame:
    """Remove marked byte ranges from whole texts.

    ``docs``: doc_id, text, text_hash (from ``with_text_hash``); ``marks``: doc_id,
    text_hash, start, end (any number of rows, overlaps allowed). Columns of the result:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept
    (binary) if asked for. One row for each row of ``docs``.
    """
    of_doc = marks.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    packed = packed_texts(docs)
    more = ["rest"] if "rest" in docs.columns else []
    joined = packed.join(of_doc, same_document(packed, of_doc), "left").select(packed["doc_id"], "z", "starts", "ends", *more)

    def work(batches):
        from hashlib import sha256

        for batch in batches:
            out = []
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, s, e in zip(unpacked(batch.column(1)), starts, ends, strict=True):
                kept, removed, runs_cut = text, 0, 0
                if s:
                    a, b = spans_of(np.array(s, np.int64), np.minimum(np.array(e, np.int64), len(text)))
                    keep_from, keep_to = np.r_[0, b], np.r_[a, len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(keep_from.tolist(), keep_to.tolist(), strict=True))
                    removed, runs_cut = len(text) - len(kept), len(a)
                out.append((len(text), removed, runs_cut, sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *cols, *batch.columns[4:]], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text + more
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    schema += "".join(f", rest {docs.schema['rest'].dataType.simpleString()}" for _ in more)
    cut = joined.mapInArrow(tidied(work), schema)
    return cut if keep_text else digests(cut)
