"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

Writing. Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
smallest id is a response and the others are revisit records that refer to it. Ids and digests alone
decide which; a fixed-size Bloom filter of the revisits then passes all other payloads to their record
without a shuffle. Responses that it mistakes for revisits are known by id and digest, too: a second
filter, of these, finds their payloads, and an exact join of the few that pass both settles them.
Spark's text sink writes whole records, so that lost tasks are redone by its commit protocol.

Reading. Files are read in splits. Every "blank line, WARC/" is a candidate start of a record, be
it a record or bytes of a payload. A task emits for each candidate its offset and, by the length
in its header, the offset of its successor. Within a split, chains are followed back to front, so
that each candidate knows where its chain leaves the split; between splits, pointer jumping from
the start of each file finds in log2(splits) rounds which offsets are reached. Only candidates on
that chain are records. Payloads that hold candidates are put together from their parts in a
second scan, which runs only if there are any.

Defined results: a null payload is empty; rows with equal ids and payloads are all responses (or
all revisits); line ends in a URL are percent-encoded; a candidate without a readable header, or with
a length beyond ``LONGEST``, ends its chain and is no record; an id that is no 64-bit number is null;
an empty table gives an archive without records; columns beside id, url and payload, whatever their
names, are not written.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import bounded_batches, column, materialize

MIN_REVISIT = 100
URN = "urn:page:"
#: 64-bit words of a Bloom filter, a power of two: 8 MB at any size of table.
WORDS = 1 << 20
#: Fixed by the format: line end, end of header, end of record, what starts one.
CRLF, MAGIC = "\r\n", "WARC/"
BOUNDARY = CRLF + CRLF + MAGIC
_BOUNDARY, _HEAD_END = BOUNDARY.encode(), (CRLF + CRLF).encode()
_VERSION = re.compile(rb"\d+\.\d+\r\n")
_NUMBER = re.compile(r"-?[0-9]{1,19}")
#: The largest length that a header can give, such that offsets stay 64-bit numbers.
LONGEST = 10**18


def _places(h) -> list:
    """The two hashes that a filter knows a row by."""
    return [h, F.xxhash64(h)]


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of a table of one column h, combined in the tasks before the shuffle."""
    bits = hashes.select(F.explode(F.array(*_places(F.col("h")))).alias("h"))
    bits = bits.select(F.pmod("h", F.lit(WORDS)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(WORDS, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _may_hold(words: np.ndarray):
    """Whether a filter may hold a row, as a function of its two hashes; never false if it does."""

    @F.pandas_udf("boolean")
    def check(h: pd.Series, other: pd.Series) -> pd.Series:
        good = np.ones(len(h), bool)
        for x in (h.to_numpy(np.int64), other.to_numpy(np.int64)):
            good &= (words[x & (len(words) - 1)] >> ((x >> 40) & 63)) & 1 == 1
        return pd.Series(good)

    return check


def without(rows: DataFrame, narrow: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose (id, sha) is not in ``gone``; ``narrow`` has the ids and digests of all rows."""
    own, again = F.xxhash64("id", "sha"), F.xxhash64(F.lit(1), F.col("id"), F.col("sha"))
    first = _may_hold(_filter(gone.select(own.alias("h"))))
    is_gone = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    pairs = gone.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
    spared = narrow.select("id", "sha").where(first(*_places(own))).join(pairs, is_gone, "left_anti")
    spared = materialize(spared.distinct(), "spared")
    kept = rows.where(~first(*_places(own)))
    if spared.isEmpty():
        return kept
    second = _may_hold(_filter(spared.select(again.alias("h"))))
    doubt = rows.where(first(*_places(own)) & second(*_places(again)))
    pairs = spared.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
    return kept.unionByName(doubt.join(pairs, is_gone, "left_semi"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row, to text files of whole records below ``path``."""
    body = F.coalesce(column(payload_col).cast("string"), F.lit(""))
    base = pages.select(column(id_col).cast("bigint").alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce(column(url_col).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    narrow = materialize(base.select("id", "url", digest.alias("sha"), F.octet_length("body").cast("bigint").alias("n")), "payloads")
    first = narrow.where(F.col("n") >= MIN_REVISIT).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    again = materialize(narrow.join(materialize(first, "copied"), "sha").where(~F.col("id").eqNullSafe(F.col("first"))), "revisits")
    kept = without(base.withColumn("sha", digest), narrow, again.select("id", "sha").distinct())

    def header(kind: str, *more):
        name = F.coalesce(F.col("id").cast("string"), F.lit(""))
        lines = [F.lit(f"{MAGIC}1.0{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <{URN}"), name, F.lit(f">{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("sha"), *more]
        return F.concat(*lines)

    full = kept.select(F.concat(header("response", F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length("body").cast("string")), F.lit(CRLF + CRLF), F.col("body")).alias("value"))
    short = again.select(F.concat(header("revisit", F.lit(f"{CRLF}WARC-Refers-To: <{URN}"), F.col("first").cast("string"), F.lit(f">{CRLF}Content-Length: 0")), F.lit(CRLF + CRLF)).alias("value"))
    full.unionByName(short).write.option("lineSep", CRLF + CRLF).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def _urn(value: bytes | None) -> int | None:
    text = (value or b"").decode("latin-1").strip("<>").removeprefix(URN)
    number = int(text) if _NUMBER.fullmatch(text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def parse(chunk: bytes, bounded: bool = False) -> tuple[int, int, str, int | None, int | None] | None:
    """Of bytes after "WARC/": length of the header, of the content, type, id, refers-to.

    A ``bounded`` chunk is followed by a boundary, whose blank line may be the header's end: a
    payload that starts with "WARC/" or a line end and "WARC/" is cut off there.
    """
    if not _VERSION.match(chunk):
        return None
    end = chunk.find(_HEAD_END)
    if end < 0 and bounded:
        end = len(chunk) - len(CRLF) * chunk.endswith(CRLF.encode())
    if end < 0:
        return None
    have = _fields(chunk[:end])
    length = have.get(b"content-length", b"").lstrip(b"0") or have.get(b"content-length", b"")[:1]
    if not length.isdigit() or len(length) > len(str(LONGEST)) or int(length) > LONGEST:
        return None
    return end + 4, int(length), have.get(b"warc-type", b"").decode("latin-1"), _urn(have.get(b"warc-record-id")), _urn(have.get(b"warc-refers-to"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", BOUNDARY).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _chunks(batches):
    """(file, split, number in the split, offset in the split, bytes) of what lies between boundaries.

    Offsets count from the split's first chunk and point behind the magic word; a file's first
    chunk has no boundary before it, so its own magic word is taken off.
    """
    at = None
    for batch in batches:
        for value, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at is None or at[:2] != (file, split):
                at, seq, offset = (file, split), 0, 0
            for part in value.as_py().split(_BOUNDARY):
                if seq == 0 and split == 0 and part.startswith(MAGIC.encode()):
                    part, offset = part[len(MAGIC) :], len(MAGIC)
                yield file, split, seq, offset, part
                seq, offset = seq + 1, offset + len(part) + len(_BOUNDARY)


CANDIDATE = "file string, split bigint, seq bigint, pos bigint, size bigint, succ bigint, whole boolean, kind string, id bigint, refers bigint, n bigint, sha string"
_CANDIDATE_ARROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("pos", pa.int64()), ("size", pa.int64()), ("succ", pa.int64()), ("whole", pa.bool_()), ("kind", pa.string()), ("id", pa.int64()), ("refers", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])


def _record_batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _candidates(batches):
    rows = []
    for file, split, seq, offset, part in _chunks(batches):
        # a file's last chunk has no boundary behind it; if its header has no end, _assemble drops it
        found = parse(part, bounded=True)
        if found is None:
            rows.append((file, split, seq, offset, len(part), None, False, None, None, None, None, None))
        else:
            head, length, kind, rid, refers = found
            whole = head + length <= len(part)
            sha = hashlib.sha256(memoryview(part)[head : head + length]).hexdigest() if whole else None
            rows.append((file, split, seq, offset, len(part), offset + head + length + len(_BOUNDARY), whole, kind, rid, refers, length, sha))
        if len(rows) >= 5000:
            yield _record_batch(rows, _CANDIDATE_ARROW)
            rows = []
    if rows:
        yield _record_batch(rows, _CANDIDATE_ARROW)


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves the split (null: it ends inside)."""
    part = part.sort_values("pos")
    pos, succ = part["pos"].to_numpy(), part["succ"].fillna(-1).to_numpy(np.int64)
    place = np.minimum(np.searchsorted(pos, succ), len(pos) - 1)
    inside = pos[place] == succ
    beyond = succ > pos[-1]
    out = np.full(len(pos), -1, np.int64)
    for i in range(len(pos) - 1, -1, -1):
        if inside[i]:
            out[i] = out[place[i]]
        elif beyond[i]:
            out[i] = succ[i]
    return pd.DataFrame({"file": part["file"], "pos": pos, "leaves": pd.array(np.where(out < 0, None, out), "Int64")})


def _walk(part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chains from its reached entries."""
    part = part.sort_values("pos")
    pos, succ = part["pos"].to_numpy(), part["succ"].fillna(-1).to_numpy(np.int64)
    good = np.zeros(len(pos), bool)
    for entry in entries["pos"]:
        while True:
            i = int(np.searchsorted(pos, entry))
            if i >= len(pos) or pos[i] != entry or good[i]:
                break
            good[i], entry = True, succ[i]
    return part[good]


def verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records on the chains from the files' starts, all candidates), at absolute offsets."""
    bounded_batches(spark)
    found = materialize(_lines(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    sizes = found.groupBy("file", "split").agg(F.max(F.col("pos") + F.col("size") + len(BOUNDARY)).alias("bytes"))
    base = F.sum("bytes").over(Window.partitionBy("file").orderBy("split")) - F.col("bytes")
    found = found.join(sizes.select("file", "split", base.alias("base")), ["file", "split"])
    found = materialize(found.withColumns({"pos": F.col("pos") + F.col("base"), "succ": F.col("succ") + F.col("base")}).drop("base"), "offsets")
    chain = found.select("file", "split", "pos", "succ")
    leaves = materialize(chain.groupBy("file", "split").applyInPandas(_exits, "file string, pos bigint, leaves bigint"), "exits")
    start = leaves.where(F.col("pos") == len(MAGIC)).select("file", "pos")
    # what any chain enters: about one offset for each split, and all that matters between splits
    entered = leaves.where("leaves is not null").select("file", F.col("leaves").alias("pos")).unionByName(start).distinct()
    jump = materialize(leaves.join(entered, ["file", "pos"]), "jumps")
    reached = materialize(start, "reached")
    count = -1
    while True:
        hop = jump.select("file", "pos", F.col("leaves").alias("to")).where("leaves is not null")
        reached = materialize(reached.unionByName(reached.join(hop, ["file", "pos"]).select("file", F.col("to").alias("pos"))).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        second = jump.select("file", F.col("pos").alias("leaves"), F.col("leaves").alias("next"))
        jump = materialize(jump.join(second, ["file", "leaves"], "left").select("file", "pos", F.col("next").alias("leaves")), "jumps")
    entries = materialize(reached.join(found.select("file", "split", "pos"), ["file", "pos"]).select("file", "split", "pos"), "entries")
    records = found.groupBy("file", "split").cogroup(entries.groupBy("file", "split")).applyInPandas(_walk, CANDIDATE)
    return materialize(records, "records"), found


_PART = "file string, split bigint, seq bigint, part binary"


def _parts(batches):
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("part", pa.binary())])
    for file, split, seq, _, part in _chunks(batches):
        yield _record_batch([(file, split, seq, part)], schema)


def _assemble(part: pd.DataFrame) -> pd.DataFrame:
    """One record whose payload holds boundaries, from its parts in order."""
    whole = _BOUNDARY.join(part.sort_values("pos")["part"])
    found = parse(whole)
    if found is None:  # the file ends inside the header
        return pd.DataFrame(columns=["kind", "id", "refers", "n", "sha"], dtype=object)
    head, length, kind, rid, refers = found
    body = whole[head : head + length]
    return pd.DataFrame({"kind": [kind], "id": pd.array([rid], "Int64"), "refers": pd.array([refers], "Int64"), "n": [len(body)], "sha": [hashlib.sha256(body).hexdigest()]})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, kind, refers, n, sha) of the records below ``path``; revisits have null n and sha."""
    records, found = verified(spark, path)
    short = records.where("not whole and succ is not null").select("file", "pos", "succ")
    own = records.where("whole").select("kind", "id", "refers", "n", "sha")
    if not short.isEmpty():
        owner = F.last(F.when(F.col("start"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))
        starts = records.select("file", "pos", F.lit(True).alias("start"))
        owned = found.join(starts, ["file", "pos"], "left").select("file", "split", "seq", "pos", owner.alias("owner"))
        owned = materialize(owned.join(short.select("file", F.col("pos").alias("owner")), ["file", "owner"]), "parts")
        parts = _lines(spark, path).mapInArrow(_parts, _PART).join(owned, ["file", "split", "seq"])
        own = own.unionByName(parts.groupBy("file", "owner").applyInPandas(_assemble, "kind string, id bigint, refers bigint, n bigint, sha string"))
    return own.withColumns({x: F.when(F.col("kind") != "revisit", F.col(x)) for x in ("n", "sha")})


def resolve(records: DataFrame) -> DataFrame:
    """Gives revisits the payload length and digest of the response that they refer to."""
    records = materialize(records, "read_back")
    responses = records.where("kind = 'response'").select(F.col("id").alias("refers"), F.col("n").alias("of_n"), F.col("sha").alias("of_sha"))
    again = records.where("kind = 'revisit'")
    wanted = again.select("refers").distinct()
    responses = materialize(responses.join(wanted, "refers", "left_semi").dropDuplicates(["refers"]), "referred")
    again = again.join(responses, "refers", "left").select("id", "kind", "refers", F.col("of_n").alias("n"), F.col("of_sha").alias("sha"))
    return records.where("kind <> 'revisit'").select("id", "kind", F.lit(None).cast("bigint").alias("refers"), "n", "sha").unionByName(again)
