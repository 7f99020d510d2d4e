"""Document fingerprints from chains of content words that follow common words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridmosaic.llm.hashing import LOWER, WORD_BYTES

# The most common words of English, German, Spanish and French.
COMMON_WORDS = (
    "the of and to a in is that it for was on with be by as this are at from "
    "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine "
    "de la que el en y los se del las por un no con su una es para al lo "
    "le et les des du une pour est qui par dans sur au pas avec"
).split()
CHAIN = 3  # content words of a signature
SIGNATURE_BYTES = 4
BUCKET_ROWS = 4096
MAX_BUCKETS = 10_000  # larger tables have larger buckets

_ANCHORS = frozenset(w.encode() for w in COMMON_WORDS)


def signatures(text: str) -> list[bytes]:
    """The distinct signatures of a text, in order.

    An anchor is a common word; its signature is the hash of it and the next `CHAIN` words that are not common. A text without a whole chain has one
    signature, of all its words, or if it has none, of the text itself. Only an empty text has none. A-Z are lowered.
    """
    raw = text.encode().translate(LOWER)
    words = WORD_BYTES.findall(raw)
    content: list[bytes] = []
    places: list[tuple[bytes, int]] = []
    for w in words:
        if w in _ANCHORS:
            places.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - CHAIN
    found = {md5(b" ".join((w, *content[k: k + CHAIN]))).digest()[:SIGNATURE_BYTES] for w, k in places if k <= last}
    if not found and raw:
        found = {md5(b" ".join(words) or raw).digest()[:SIGNATURE_BYTES]}
    return sorted(found)


def fingerprint(found: list[bytes]) -> str:
    """The signatures one after another in hex: equal sets, equal strings, and the set can be read back."""
    return b"".join(found).hex()


def likeness(a: list[bytes], b: list[bytes], least: float = 0.0) -> float:
    """Jaccard similarity of two sets; 0 if it is below `least`. Two empty sets are equal.

    Sets whose sizes alone exclude `least` are not compared.
    """
    if not a and not b:
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small == 0 or small < least * large:
        return 0.0
    common = len(set(a).intersection(b))
    found = common / (len(a) + len(b) - common)
    return found if found >= least else 0.0


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(list(zip(FIELDS, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))))
OUT_ROWS = 256


def compare_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside the next one of its bucket. Rows come in order; the last of a bucket is a guest, the first row of the next bucket. One row is held at a time."""
    held, out = None, []
    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            text = text or ""
            found = None
            if held is not None and held[0] == bucket:
                _, before, own, its = held
                found = signatures(text)
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                changed = signatures(edited)
                out.append((before, len(own), sha256(edited.encode()).hexdigest(), fingerprint(its), fingerprint(changed), likeness(its, changed), likeness(its, found)))
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
                    out = []
            held = None if guest else (bucket, doc_id, text, signatures(text) if found is None else found)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)


def in_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, guest, doc_id, text): buckets follow the order of doc_id, and each also holds, as a guest, the first row after it; after the last comes the first.

    Bounds are quantiles of the ids, so at most `MAX_BUCKETS` numbers come to the driver. Null ids come last.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MAX_BUCKETS, -(-source.count() // bucket_rows))
    ids = source.filter("doc_id IS NOT NULL").select("doc_id")
    cuts = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.float64))
    if not len(bounds):
        bounds = np.array([np.inf])

    @F.pandas_udf("int")
    def bucket_of(doc_id):
        place = np.searchsorted(bounds, doc_id.to_numpy(dtype=np.float64, na_value=np.nan), side="right")
        return doc_id.__class__(np.where(doc_id.isna(), len(bounds) + 1, place).astype(np.int32))

    placed = source.withColumn("bucket", bucket_of("doc_id"))
    firsts = placed.select("bucket", "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()
    known = sorted((r["first"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts) if r["first"] is not None)
    starts, hosts = (np.array([x[k] for x in known] or [0], dtype=np.int64) for k in (0, 1))
    of_null = next((firsts[k - 1]["bucket"] for k, r in enumerate(firsts) if r["first"] is None), -1)

    @F.pandas_udf("int")
    def host_of(doc_id, missing):
        # the bucket before the one that a row begins, else -1; joining so few rows would shuffle the texts once more
        ids = doc_id.to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(starts, ids), len(starts) - 1)
        found = np.where((starts[at] == ids) & bool(known), hosts[at], -1)
        return doc_id.__class__(np.where(missing.to_numpy(), of_null, found).astype(np.int32))

    hosted = placed.withColumn("host", host_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()))
    own = F.struct("bucket", F.lit(0).alias("guest"))
    both = F.when(F.col("host") < 0, F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))
    return hosted.select(F.explode(both).alias("place"), "doc_id", "text").select("place.*", "doc_id", "text")


def fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The fingerprint of every document and of its edited text, and how like they are.

    In the edited text the last half of the code points (rounded down) is replaced by the first as many, or all, of the next document by doc_id; after the last comes the first.
    `near_edited` and `near_next` are the Jaccard similarities of the sets behind the fingerprints: that of the document and its edited text, and that of the document and the next one.

    The texts are shuffled once, to buckets that follow doc_id, and read in order; a task holds two texts.

    Null and empty texts have the empty fingerprint, which is like itself only. Rows that share a doc_id follow each other by the hash of the text; null ids come last. A single
    row is its own next one. Long texts are read whole. Empty table: no rows. Other columns are dropped.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    placed = in_buckets(docs, bucket_rows).repartition("bucket")
    ordered = placed.sortWithinPartitions("bucket", "guest", F.asc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return ordered.mapInArrow(compare_along, SCHEMA)
