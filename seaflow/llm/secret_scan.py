"""Secret scan: spans of credentials, with weak candidates linked to what completes them.

Base kinds (fixed patterns): ``assign``, a name such as password or api_key with a value of 6 or more characters;
``access``, an access key identifier; ``hex``, a run of 24 or more hexadecimal digits. They are always reported. Three
weak kinds are reported only where complementary parts occur in the same scope, however far apart:

* ``id``, an account, user or client name: with a secret (assign, hex or key);
* ``key``, a random-looking run of 32 or more characters: with an identifier (access or id);
* ``endpoint``, a URL or IPv4 address: with an identifier and a secret.

A scope is a stretch of a text without blank line. The linking is an interval join on scopes: each is folded to the least
and the greatest span of its secrets and of its identifiers, and a candidate is joined with that one row. It has a partner
if one of the two is not its own span, so it never completes itself and no pairs are formed.

Offsets count code points, ends are exclusive. Matches of a kind are leftmost and don't overlap; matches that fail a
length are dropped. Defined results: a null text is an empty one and has no spans; rows with the same doc_id are told
apart by a hash of their text, repeated rows get the same spans; null doc_ids are an id like others. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaflow.llm.storage import written

# The order of kinds in reports, and the base patterns.
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ID_WORDS = ("access", "client", "account", "user", "login")
_ID = re.compile(
    r"""(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""")
_ADDRESS = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])(?::\d{1,5})?", re.ASCII)
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")


def _looks_random(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def find_parts(text: str) -> list[tuple[str, int, int]]:
    """All parts of a text as (kind, start, end), weak ones included, by kind and start."""
    lower = text.lower()
    found: list[tuple[str, int, int]] = []
    if any(word in lower for word in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(word in lower for word in _ID_WORDS):
        found += [("id", m.start(), m.end()) for m in _ID.finditer(text)]
    found += [("key", m.start(), m.end()) for m in _KEY.finditer(text) if _looks_random(m[0])]
    if "://" in text:
        found += [("endpoint", m.start(), m.end()) for m in _URL.finditer(text)]
    found += [("endpoint", m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            found = find_parts(text)
            blanks = [m.start() for m in _BLANK_LINE.finditer(text)] if found else []
            at, own = 0, []
            for kind, start, end in sorted(found, key=lambda x: x[1]):
                while at < len(blanks) and blanks[at] < start:
                    at += 1
                own.append({"kind": kind, "start": start, "end": end, "scope": at})
            rows.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "tie", "parts"]
        )


_SECRETS, _IDENTIFIERS = ("assign", "hex", "key"), ("access", "id")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak candidates whose scope completes them."""
    span = F.struct("start", "end")

    def bounds(kinds: tuple[str, ...], name: str) -> list[Column]:
        own = F.when(F.col("kind").isin(*kinds), span)
        return [F.min(own).alias(f"{name}_least"), F.max(own).alias(f"{name}_greatest")]

    scopes = (
        parts.groupBy(F.col("doc_id").alias("s_id"), F.col("tie").alias("s_tie"), F.col("scope").alias("s_scope"))
        .agg(*bounds(_SECRETS, "secret"), *bounds(_IDENTIFIERS, "identifier"))
        .filter("secret_least is not null or identifier_least is not null")
    )
    weak = parts.filter(F.col("kind").isin("id", "key", "endpoint"))
    met = weak.join(scopes, F.expr("doc_id <=> s_id and tie = s_tie and scope = s_scope"))

    def other(name: str) -> Column:
        return F.coalesce((F.col(f"{name}_least") != span) | (F.col(f"{name}_greatest") != span), F.lit(False))

    complete = F.when(F.col("kind") == "id", other("secret")).when(F.col("kind") == "key", other("identifier"))
    return met.filter(complete.otherwise(other("secret") & other("identifier"))).select("doc_id", "tie", "kind", "start", "end")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, base and linked, arrays of (kind, start, end) by start and kind."""
    text = F.coalesce(docs[text_column], F.lit(""))
    keyed = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tie long, parts array<struct<kind: string, start: int, end: int, scope: int>>"
    found = written(keyed.mapInArrow(_part_batches, schema), "parts")
    some = found.filter(F.exists("parts", lambda p: p["kind"].isin("id", "key", "endpoint")))
    parts = some.dropDuplicates(["doc_id", "tie"]).select("doc_id", "tie", F.inline("parts"))
    linked = _linked(parts)
    spans = linked.groupBy(F.col("doc_id").alias("s_id"), F.col("tie").alias("s_tie")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("linked")
    )
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tie") == F.col("s_tie"))
    base = F.transform(
        F.filter("parts", lambda p: p["kind"].isin("assign", "access", "hex")),
        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")),
    )
    return found.join(spans, same, "left").select(
        "doc_id",
        in_order(base).alias("base"),
        in_order(F.coalesce("linked", F.array().cast("array<struct<kind: string, start: int, end: int>>"))).alias(
            "linked"
        ),
    )


def in_order(spans: Column) -> Column:
    """Spans by start, then kind in the order of reports."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("rank"), s["end"], s["kind"])
    )
    return F.transform(
        F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
