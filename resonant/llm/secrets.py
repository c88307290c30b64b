"""Operator 4: secret scans over an incremental blob ledger.

Every text is addressed by the SHA-256 of its bytes, so a version that occurs at many paths or
points of a history is one blob. The ledger holds a row for every (blob, rule version) already
scanned; only pairs that it lacks are scanned, once each, and the findings are joined back to all
paths that hold the blob. Scanning again with the returned ledger scans nothing.

Rules: assign, access and hex, then three more kinds (pem, jwt, github) that only add spans. While texts
are addressed, a cheap byte test on the whole chunk picks those that can hold a finding at all; only these
are sent to their blob's ledger entry and, once for each unseen pair, matched. All others go as a digest.

Defined results. Null text: an empty text, no findings. Repeated rows and copies: each row gets the
findings of its blob. Extra columns are ignored. Empty tables give empty results. Texts of any length are
scanned whole. Spans with the same start are in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .spark_io import written

#: Rows of version 2 may lack findings, as its pre-test passed over some texts between others.
RULE_VERSION = "2.1"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}")
#: Kinds in the order that breaks ties between spans with the same start.
KINDS = ("assign", "access", "hex", "pem", "jwt", "github")
FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_NEEDLES = [re.compile(re.escape(x)) for x in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"akia", b"-----begin ", b"eyj", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")]
_IS_HEX = np.zeros(256, bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding in one text, in code points, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    for kind, rule in ((3, PEM), (4, JWT), (5, GITHUB)):
        out += [(m.start(), kind, m.end()) for m in rule.finditer(text)]
    return sorted(out)


def _suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts of a chunk that may hold a finding."""
    runs = W.cut(data, off, _IS_HEX, hashed=False)  # of either case; a run ends where its text does
    lower = runs.data.tobytes()
    # a needle may lie across texts and hide one that starts in its last text: both ends are looked at
    at = [x for needle in _NEEDLES for m in needle.finditer(lower) for x in (m.start(), m.end() - 1)]
    at = np.unique(np.concatenate([np.array(at, np.int64), runs.start[runs.end - runs.start >= 24]]))
    first = np.unique(np.searchsorted(off, at, "right") - 1)
    longest = np.flatnonzero(np.diff(off) == 0)
    return np.setdiff1d(first, longest)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in find(x.as_py() or "")] for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, _ARROW)], ["blob", "findings"])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content address of every text, and the text itself only where it may hold a finding."""
    for batch in batches:
        blob, text = [], [None] * batch.num_rows
        for a, _, data, off in W.chunks(batch.column("text")):
            blob += [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            for i in _suspects(data, off):
                text[a + i] = data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(text, pa.string())], ["blob", "text"])


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `blob`, the content address of their text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for what the given ledger has not seen.

    What meets by blob are digests, and texts only of blobs that may hold a finding.
    """
    blobs = versions.select(F.col(text).cast("string").alias("text")).mapInArrow(_sift, "blob string, text string").groupBy("blob").agg(F.max("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    schema = T.StructType([T.StructField("blob", T.StringType()), T.StructField("findings", FINDINGS)])
    return blobs.mapInArrow(_scan, schema).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Every row of versions with the findings of its blob (column `findings`), and the ledger with the new rows.

    The new rows are written to the shared folder once, and both results read them from there.
    """
    new = written(update_ledger(versions, ledger, text=text, rule_version=rule_version), "ledger")
    whole = new if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(new)
    found = whole.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob").alias("_blob"), F.col("findings").alias("_findings"))
    rows = versions.select(F.struct(*versions.columns).alias("_row"), F.col(text).cast("string").alias("_text"))
    rows = addressed(rows, "_text").join(found, F.col("blob") == F.col("_blob"), "left")
    findings = F.coalesce("_findings", F.array().cast(FINDINGS))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in versions.columns if c != "findings"), findings.alias("findings")), whole


def _listed(findings: F.Column) -> F.Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found, _ = scan(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def redact(documents: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span of `text` replaced by a mark; overlapping spans become one mark."""
    packed = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).cast("string").alias("body"))
    found, _ = scan(packed, text="body")
    whole = F.col("body")
    cut = F.aggregate(
        "findings",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(F.concat(a["out"], whole.substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))),
        lambda a: F.concat(a["out"], whole.substr((a["at"] + 1).cast("int"), F.length(whole))),
    )
    clean = F.when(F.size("findings") > 0, cut).otherwise(whole)
    return found.select(*(clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns))
