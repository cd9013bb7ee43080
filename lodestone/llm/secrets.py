"""Secret scans with multipart credential linking.

Strong findings (``assign``, ``access``, ``hex``) are reported by themselves. Weak candidates, an access identifier, a
high-entropy string or an endpoint, are reported only together: within a scope (a paragraph, at most ``reach`` code
points between the parts) an identifier and a secret are linked, and an endpoint is added to what they make up. The parts
of a text are intervals in order of position, and the link is an interval join done as one forward and one backward
sweep, so a text with many candidates costs no more than their number times its logarithm.

Spans are ``kind:start:end`` in code points, end exclusive. Results for odd input: a null or empty text has no span;
repeated rows give repeated results; an empty table gives an empty result; the operator adds one column, ``spans``
(array of kind, start, end) under a name of the caller's choice, in place of one of that name, and keeps all others.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import table

BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE + WEAK
REACH = 400

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA|IDA|ROA)[A-Z0-9]{8,}|(?i:(?:client|account|access_key|key)_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{6,})")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+|(?i:(?:endpoint|host|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?)")
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")


def _ascii_only_keyword(match: re.Match) -> bool:
    """Letters in either case, but not the two other letters that fold into ASCII ones."""
    return match.group(1).isascii()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strong findings, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8 and _ascii_only_keyword(m)]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def _looks_secret(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.5


def _near(parts: list[tuple[int, int, int]], others: list[tuple[int, int, int]], reach: int) -> list[bool]:
    """For each part (scope, start, end), whether one of ``others`` of its scope, not overlapping, is within reach.

    Both lists are in order of position. The nearest to the left is the one that ends last before the part, the nearest
    to the right the one that starts first after it.
    """
    ends = sorted((scope, end) for scope, _, end in others)
    starts = [(scope, start) for scope, start, _ in others]
    out = []
    for scope, start, end in parts:
        i = bisect.bisect_right(ends, (scope, start)) - 1
        j = bisect.bisect_left(starts, (scope, end))
        out.append(i >= 0 and ends[i][0] == scope and start - ends[i][1] <= reach or j < len(starts) and starts[j][0] == scope and starts[j][1] - end <= reach)
    return out


def linked_spans(text: str, base: list[tuple[int, str, int]], reach: int = REACH) -> list[tuple[int, str, int]]:
    """The weak candidates that complementary parts of their scope complete."""
    ids = [(m.start(), "weak_id", m.end()) for m in _WEAK_ID.finditer(text)] if "_" in text or "AKIA" in text or "ASIA" in text or "AIDA" in text or "AROA" in text or "id" in text.lower() and ("=" in text or ":" in text) else []
    strong_ids = [s for s in base if s[1] == "access"]
    if not ids and not strong_ids:
        return []
    strong_secrets = [s for s in base if s[1] != "access"]
    taken = sorted((s[0], s[2]) for s in base)

    def free(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Without those that a strong finding overlaps."""
        kept, k, reached = [], 0, -1
        for s in spans:
            while k < len(taken) and taken[k][0] < s[2]:
                reached = max(reached, taken[k][1])
                k += 1
            if reached <= s[0]:
                kept.append(s)
        return kept

    ids = free(ids)
    secrets = free([(m.start(), "weak_secret", m.end()) for m in _WEAK_SECRET.finditer(text) if _looks_secret(m.group())])
    points = free([(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]) if "://" in text or ":" in text or "=" in text else []
    breaks = [m.start() for m in _SCOPE_END.finditer(text)]
    placed = lambda spans: sorted((bisect.bisect_left(breaks, s[0] + 1), s[0], s[2]) for s in spans)
    all_ids, all_secrets = placed(ids + strong_ids), placed(secrets + strong_secrets)
    id_paired, secret_paired = _near(all_ids, all_secrets, reach), _near(all_secrets, all_ids, reach)
    good_ids = [p for p, yes in zip(all_ids, id_paired, strict=True) if yes]
    good_secrets = [p for p, yes in zip(all_secrets, secret_paired, strict=True) if yes]
    spots = placed(points)
    by_id, by_secret = _near(spots, good_ids, reach), _near(spots, good_secrets, reach)
    good = {("weak_id", *p[1:]) for p in good_ids} | {("weak_secret", *p[1:]) for p in good_secrets} | {("endpoint", *p[1:]) for p, a, b in zip(spots, by_id, by_secret, strict=True) if a and b}
    return [s for s in ids + secrets + points if (s[1], s[0], s[2]) in good]


def find_spans(text: str | None, reach: int = REACH) -> list[tuple[int, str, int]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    spans = base + linked_spans(text, base, reach)
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    return spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans", reach: int = REACH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, all by default) with an array column of the spans of each whole text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_s_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in find_spans(t.as_py(), reach)] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW_SPANS)], names=[f.name for f in schema.fields])

    return source.mapInArrow(scan, schema)


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of op4 from plain loops, for tests."""
    rules = ((r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8), (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16), (r"[0-9a-f]+", lambda m: len(m.group()) >= 32))
    spans, counts = [], []
    for k, (pattern, good) in enumerate(rules):
        found = [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if good(m)]
        counts.append(len(found))
        spans += found
    joined = ",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = with_spans(docs, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
