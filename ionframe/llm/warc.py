"""WARC archives: writing with revisit records, and reading by boundary chains.

Archives are plain (uncompressed) WARC/1.1 files that Spark's text writer makes: a row is a
record, the line separator is the blank lines that end a record.  So any store that Spark
writes will do.

Reading splits files at arbitrary lines.  Each task looks for the record magic at line starts
of its split and emits every candidate with the offset of its successor (header and
Content-Length tell it).  Payloads may hold the magic too, so candidates are only claims.
A file's first record starts at 0 and every true record is reached from there: within a
split a candidate's chain is followed to the first offset outside it, then pointer jumping
over those exits (the length doubles each round, so log2(splits of a file) rounds) finds the
entries of every split that the chain from 0 reaches, and following the chain from an entry
inside its split marks the true records.  Other candidates are rejected.

A header may have any length and run over any number of splits: one that is open at its
split's end is put together from the first bytes of the following splits, up to the split in
which it ends.  Records that end in a later split are put together from the pieces of bytes
that splits emit for the purpose; no other payload is shuffled.  A chain that ends before its
file does is an error, as the records behind it would be lost.

Only plain files are read; archives whose records are compressed one by one are not.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

MAGIC = b"WARC/1."
#: Bytes of the cells by which pieces of records that span splits are joined.
CELL = 1 << 20
_ID = re.compile(r"<urn:x-page:(-?\d+)>")
_END = "\r\n\r\n"
_CUT = _END.encode()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits in groups of 10, which are 8 digits to base 32."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record for each row of pages (page_id, url, html; null html counts as empty).

    Of the rows with one payload of at least least_bytes, that with the largest page_id is a
    response and the others are revisits that refer to it; smaller ones are all responses.
    Rows that repeat the largest page_id are responses as well.  A null id is less than any
    other.  Line breaks in a url are percent-encoded; a null url is left out.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    ids = p.where(F.col("n") >= least_bytes).select("digest", "page_id")
    # ids and digests only; a very common payload is a hot digest on this side alone, whose join Spark splits
    largest = ids.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c")).where("c > 1").select("digest", "response")
    revisits = ids.distinct().join(largest, "digest").where("not page_id <=> response")
    # few rows unless there are many copies; Spark broadcasts them where their size allows it
    revisits = materialize(revisits.select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), "response"), "warc-revisits")
    r = p.join(revisits, F.col("digest").eqNullSafe(F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left")
    again = F.col("_d").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n"))).cast("string")),
    )
    record = F.concat(header, F.lit(_END), http, F.when(again, F.lit("")).otherwise(F.col("html")))
    r.select(record.alias("value")).write.option("lineSep", _END).text(path)


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _length(fields: dict[str, str]) -> int | None:
    v = fields.get("content-length", "")
    return int(v) if v.isascii() and v.isdigit() and len(v) < 19 else None


_RECORD = ["record_type", "record_id", "refers_to", "uri", "declared", "full_bytes", "payload_digest", "payload"]


def _record(fields: dict[str, str], block: bytes, keep: bool) -> dict:
    """What a record says, from its fields and its whole block."""
    head, cut, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    full = _length(_fields(head)) if cut else None
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"),
        "declared": fields.get("warc-payload-digest"), "full_bytes": len(body) if full is None else full,
        "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "payload": body if keep else None,
    }


#: Rows of a scan.  kind "split": bytes of the split in size; "candidate": rel, size, body (where
#: the block begins), exit (rel offset outside the split or of an open one, null for a dead end),
#: next (rel of the next in the split) and the record if the split holds all of it, else its
#: bytes so far in piece; "open": a header cut by the split's end, in piece; "head" and "piece":
#: the split's first bytes.
_RECORD_DDL = "record_type string, record_id string, refers_to string, uri string, declared string, full_bytes long, payload_digest string, payload binary"
_SCAN = "file string, block long, kind string, rel long, size long, body long, exit long, next long, piece binary, " + _RECORD_DDL
_SCAN_NAMES = [x.split()[0] for x in _SCAN.split(", ")]


def _parse(file: str, block: int, data: bytes, keep: bool, whole: bool) -> list[dict]:
    base = {"file": file, "block": block}
    out = [base | {"kind": "split", "size": len(data)}]
    if whole:
        return [*out, *(base | {"kind": "piece", "rel": at, "piece": data[at : at + CELL]} for at in range(0, len(data), CELL))]
    if block:
        # an end that lies across the border shows in the first three bytes already
        ends = data.find(_CUT)
        out.append(base | {"kind": "head", "rel": 0, "size": int(ends >= 0), "piece": data[: ends + 4] if ends >= 0 else data})
    found, opened, at = {}, set(), data.find(MAGIC)
    while at >= 0:
        if at == 0 or data[at - 1] == 10:
            end = data.find(_CUT, at)
            if end >= 0:
                fields = _fields(data[at:end])
                n = _length(fields)
                if n is not None:
                    found[at] = (end + 4, n, fields)
            else:
                opened.add(at)
        at = data.find(MAGIC, at + 1)
    exits: dict[int, int | None] = {}
    followers = set()
    for at in sorted(found, reverse=True):
        body, n, fields = found[at]
        succ = body + n + 4
        inside = succ in found
        exits[at] = succ if succ >= len(data) or succ in opened else exits[succ] if inside else None
        followers.add(succ)
        row = base | {"kind": "candidate", "rel": at, "size": succ - at, "body": body - at, "exit": exits[at], "next": succ if inside else None}
        row |= _record(fields, data[body : body + n], keep) if body + n <= len(data) else {"piece": data[at:]}
        out.append(row)
    out += [base | {"kind": "open", "rel": at, "piece": data[at:]} for at in opened]
    if block:
        roots = [at for at in found if at not in followers and exits[at] is not None] + [at for at in opened if at not in followers]
        first = max(roots, default=len(data))
        out.append(base | {"kind": "piece", "rel": 0, "piece": data[:first]})
    return out


def _scan(spark: SparkSession, path, keep: bool = False, whole: bool = False) -> DataFrame:
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.record_batch([pa.array([r.get(n) for r in rows], kinds[x.split()[1]]) for n, x in zip(_SCAN_NAMES, _SCAN.split(", "))], names=_SCAN_NAMES)

    def run(batches):
        key, data = None, []
        for b in batches:
            n = len(b)
            if not n:
                continue
            files, blocks, lines = b.column(0), b.column(1), b.column(2)
            change = (np.asarray(blocks)[1:] != np.asarray(blocks)[:-1]) | pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own = (files[lo].as_py(), blocks[lo].as_py())
                if own != key:
                    if key:
                        yield batch(_parse(*key, b"".join(data), keep, whole))
                    key, data = own, []
                data += [b"\n".join(lines.slice(lo, hi - lo).to_pylist()), b"\n"]
        if key:
            yield batch(_parse(*key, b"".join(data), keep, whole))

    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(run, _SCAN)


def _place(scan: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of a scan with the absolute offset of rel."""
    return scan.join(splits, ["file", "block"]).withColumn("offset", F.col("start") + F.col("rel"))


def _splits(scan: DataFrame) -> DataFrame:
    """(file, block, start, ordinal, length): a split's first line begins where the lines of the splits before it end."""
    w = Window.partitionBy("file").orderBy("block")
    s = scan.where("kind = 'split'").select("file", "block", F.col("size").alias("length"))
    return s.select("file", "block", "length", (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("start"), F.row_number().over(w).alias("ordinal"))


def _chain(frame: pd.DataFrame) -> pd.DataFrame:
    """Marks what is reached from the entries of one split; a split bounds the rows."""
    succ = dict(zip(frame["rel"], frame["next"]))
    true = set()
    for at in frame.loc[frame["entry"], "rel"]:
        while at is not None and at in succ and at not in true:
            true.add(at)
            nxt = succ[at]
            at = None if pd.isna(nxt) else int(nxt)
    return frame.loc[frame["rel"].isin(true), ["file", "block", "rel"]]


def read(spark: SparkSession, path, keep_payload: bool = True) -> DataFrame:
    """The records of the archives at path: file, offset, record_type, record_id, refers_to,
    uri, declared (digest field), full_bytes (of the full payload: for a revisit as its HTTP
    header says), payload_digest (of the bytes read) and payload (null unless kept).

    Raises ValueError where a file's chain of records ends before the file does (a file that
    is cut off, or that holds something else).  Fields that a record lacks are null.
    """
    scan = materialize(_scan(spark, path, keep_payload), "warc-scan")
    splits = materialize(_splits(scan), "warc-splits")
    placed = _place(scan.where("kind = 'candidate'"), splits)
    meta = ["file", "block", "rel", "offset", "size", "body", "exit", "next", "start"]
    found = placed.select(*meta)
    most = splits.agg(F.max("ordinal")).first()[0] or 0
    late = None
    if most > 1:
        late = _opened(scan, splits)
        found = found.unionByName(late.select(*meta))
    found = materialize(found, "warc-candidates")
    # the exits as absolute offsets; an entry is where the chain comes into a split
    jump = found.where("exit is not null").select("file", "offset", (F.col("start") + F.col("exit")).alias("to"))
    reached = found.where("offset = 0").select("file", "offset")
    rounds = int(np.ceil(np.log2(max(most, 1)))) + 2 if most > 1 else 0
    for _ in range(rounds):  # open headers make up to two steps in a split
        step = jump.select("file", "offset", "to")
        reached = materialize(reached.unionByName(reached.join(step, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "warc-reached")
        further = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("to2"))
        jump = materialize(jump.join(further, ["file", "to"]).select("file", "offset", F.col("to2").alias("to")), "warc-jump")
    marked = found.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    true = marked.select("file", "block", "rel", "next", "entry").groupBy("file", "block").applyInPandas(_chain, "file string, block long, rel long")
    true = materialize(true.join(found, ["file", "block", "rel"]), "warc-true")
    _check_ends(true, splits)
    names = ["file", "offset", *_RECORD]
    whole = placed.where("record_type is not null or payload_digest is not null").join(true.select("file", "offset"), ["file", "offset"], "left_semi").select(*names)
    return whole.unionByName(_joined(spark, path, scan, splits, placed, late, true, keep_payload)) if most > 1 else whole


def _check_ends(true: DataFrame, splits: DataFrame) -> None:
    last = true.groupBy("file").agg(F.max(F.col("offset") + F.col("size")).alias("chain"))
    length = splits.groupBy("file").agg(F.sum("length").alias("length"))
    # the reader of lines sees one line feed more than there is if a file doesn't end with one
    bad = length.join(last, "file", "left").where("length > 0 and (chain is null or chain < length - 1 or chain > length)")
    short = bad.select("file", "chain", "length").limit(3).collect()
    if short:
        raise ValueError(f"the records of {short[0].file} end at byte {short[0].chain} of {short[0].length}")


def _opened(scan: DataFrame, splits: DataFrame) -> DataFrame:
    """Candidates whose header ends in a later split.

    Splits between two header ends are one run; a header that is open at a split's end goes on
    through the following run, so its bytes are that run's heads, in order.  A run's bytes are
    one header at most, whatever the file's size.
    """

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                data = r.piece + b"".join(h["piece"] for h in (r.heads if r.heads is not None else []))
                end = data.find(_CUT)
                n = _length(_fields(data[:end])) if end >= 0 else None
                if n is not None:
                    size = end + 8 + n
                    rows.append((r.file, r.block, r.rel, r.offset, size, end + 4, r.rel + size, None, r.start, r.piece))
            yield pd.DataFrame(rows, columns=["file", "block", "rel", "offset", "size", "body", "exit", "next", "start", "piece"])

    order = Window.partitionBy("file").orderBy("ordinal")
    ends = scan.where("kind = 'head'").select("file", "block", F.col("size").alias("ends"))
    # a split's run is counted by the ends before it; the split after an open header begins its run's rest
    runs = splits.join(ends, ["file", "block"], "left").select("file", "block", "ordinal", F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run"))
    runs = runs.select("file", "block", "ordinal", "run", F.lead("run").over(order).alias("next_run"))
    opens = _place(scan.where("kind = 'open'"), splits).select("file", "block", "rel", "offset", "start", "ordinal", "piece")
    opens = opens.join(runs.select("file", "block", F.col("next_run").alias("run")), ["file", "block"]).where("run is not null")
    wanted = opens.groupBy("file", "run").agg(F.min("ordinal").alias("after"))
    heads = scan.where("kind = 'head'").select("file", "block", "piece").join(runs, ["file", "block"]).join(wanted, ["file", "run"]).where("ordinal > after")
    heads = heads.select("file", "run", F.col("ordinal").alias("at"), "piece")
    # a header is open at one split's end at least; the splits behind that are its rest
    found = opens.withColumnRenamed("piece", "own").join(heads.withColumnRenamed("piece", "head"), ["file", "run"], "left").where("at is null or at > ordinal")
    found = found.groupBy("file", "block", "rel").agg(F.first("offset").alias("offset"), F.first("start").alias("start"), F.first("own").alias("piece"),
                                                      F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("at", F.col("head").alias("piece"))))).alias("heads"))
    return materialize(found.mapInPandas(run, "file string, block long, rel long, offset long, size long, body long, exit long, next long, start long, piece binary"), "warc-open")


def _joined(spark, path, scan, splits, placed, late, true, keep) -> DataFrame:
    """The true records that end in a later split."""
    own = placed.where("payload_digest is null").select("file", "offset", "size", "body", "piece").unionByName(late.select("file", "offset", "size", "body", "piece"))
    own = materialize(own.join(true.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-spanning")
    cell = lambda c: F.floor(c / CELL).cast("long")
    need = own.select("file", "offset", (F.col("offset") + F.octet_length("piece")).alias("lo"), (F.col("offset") + F.col("size") - 4).alias("hi"))

    def gather(pieces: DataFrame) -> DataFrame:
        p = _place(pieces.where("kind = 'piece'"), splits).select("file", F.col("offset").alias("at"), F.col("piece").alias("bytes")).where("octet_length(bytes) > 0")
        p = p.withColumn("cell", F.explode(F.sequence(cell(F.col("at")), cell(F.col("at") + F.octet_length("bytes") - 1))))
        n = need.where("lo < hi").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
        j = n.join(p, ["file", "cell"]).where((F.col("at") < F.col("hi")) & (F.col("at") + F.octet_length("bytes") > F.col("lo")) & (F.col("cell") == F.greatest(cell(F.col("lo")), cell(F.col("at")))))
        return j.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("more"))

    def assembled(more: DataFrame) -> DataFrame:
        return own.join(more, ["file", "offset"], "left")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                data = r.piece
                for m in r.more if r.more is not None else []:
                    skip = r.offset + len(data) - m["at"]
                    if skip >= 0:
                        data += m["bytes"][skip:]
                end = r.size - 4
                rows.append({"file": r.file, "offset": r.offset, "short": len(data) < end} | _record(_fields(data[: r.body - 4]), data[r.body : end], keep))
            yield pd.DataFrame(rows, columns=["file", "offset", "short", *_RECORD])

    ddl = "file string, offset long, short boolean, " + _RECORD_DDL
    out = materialize(assembled(gather(scan)).mapInPandas(run, ddl), "warc-joined")
    if not out.where("short").isEmpty():
        # a payload that fakes the border of the next record, or a cut file: look at all bytes
        out = materialize(assembled(gather(_scan(spark, path, whole=True))).mapInPandas(run, ddl), "warc-joined")
        if not out.where("short").isEmpty():
            raise ValueError("a record is longer than its file")
    return out.drop("short")


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages to path and reads the archives back: page_id, payload_bytes, payload_digest
    (of the full payload), record_type, refers_to, and intact: the digest of the bytes that
    were read is the declared one, which must hold for responses."""
    write(pages, path, least_bytes)
    r = read(pages.sparkSession, path, keep_payload=False)
    number = lambda c: F.regexp_extract(c, _ID.pattern, 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return r.select(
        number("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"),
        F.when(revisit, F.substring("declared", 6, 32)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"), (revisit | (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("declared"))).alias("intact"),
    )
