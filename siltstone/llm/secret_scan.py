"""Operator 11: secret scans.

Three steps, each on what the one before left. An Aho-Corasick automaton holds
the literal beginnings of all kinds and reads each text once, ASCII letters
folded. Kinds without a literal begin with a run of one class of characters, so
the text is read once more for each such class, its members folded to one
symbol and the run to be found being the word of the automaton. A regular
expression is tried at the places that were hit, anchored there, and nowhere
else. Kinds whose secrets carry a checksum must then pass it.

A pattern of a kind matches only where one of its words begins, so trying it at
the hits in order, each beyond the last match's end, finds what a search of the
whole text would: leftmost, not overlapping.

| kind | begins with | checked by |
|-|-|-|
| assign | a name such as password, then = or : | length of the value |
| access | AKIA | length |
| hex | 24 hexadecimal digits | length |
| github | ghp_, gho_, ghu_, ghs_, ghr_ | CRC-32 of the first 30 characters in the last 6, base 62 |
| npm | npm_ | the same |
| card | 4 digits | Luhn's sum |

All bytes of the patterns are ASCII, which never occurs inside a longer UTF-8
character; texts are read as bytes and places then counted in code points.

Defined cases: a null text counts as empty and has no spans; very long texts
are read whole; repeated rows are scanned each; overlapping spans of different
kinds are all reported, by start, then in the order of the table above; an
empty table gives an empty result; other columns, whatever their names, pass
through `scanned` and `masked`, and a column `spans` is replaced by `scanned`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, table, unpacked

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_tail(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the 30 before them, base 62."""
    crc, digits = zlib.crc32(token[-36:-6]), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits.encode() == token[-6:]


def luhn(number: bytes) -> bool:
    digits = [x - 48 for x in reversed(number) if 48 <= x <= 57]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """words: literal beginnings, in lower case; or run: a class of bytes and how many of them it begins with."""

    name: str
    pattern: re.Pattern
    right: Callable[[re.Match], bool]
    words: tuple[bytes, ...] = ()
    run: tuple[bytes, int] = (b"", 0)


KINDS = [
    Kind("assign", re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), lambda m: len(m[2]) >= 6, words=(b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
    Kind("access", re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, words=(b"akia",)),
    Kind("hex", re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 24, run=(b"0123456789abcdef", 24)),
    Kind("github", re.compile(rb"\bgh[pousr]_[0-9A-Za-z]{36}\b"), lambda m: crc_tail(m[0]), words=(b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Kind("npm", re.compile(rb"\bnpm_[0-9A-Za-z]{36}\b"), lambda m: crc_tail(m[0]), words=(b"npm_",)),
    Kind("card", re.compile(rb"\b(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4})\b"), lambda m: luhn(m[0]), run=(b"0123456789", 4)),
]
BASE = ["assign", "access", "hex"]
SPANS = "array<struct<kind: string, start: long, end: long>>"
_FOLDED = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


@lru_cache(maxsize=1)
def automata() -> list[tuple[bytes, ahocorasick.Automaton, bool]]:
    """(translation of bytes, automaton over what it gives, whether the words are runs), made once in each worker."""
    literal = ahocorasick.Automaton()
    for n, kind in enumerate(KINDS):
        for word in kind.words:
            literal.add_word(word.decode("latin-1"), (n, len(word)))
    literal.make_automaton()
    out = [(_FOLDED, literal, False)]
    for n, kind in enumerate(KINDS):
        members, least = kind.run
        if least:
            one = ahocorasick.Automaton()
            one.add_word("x" * least, (n, least))
            one.make_automaton()
            out.append((bytes(120 if x in members else 46 for x in range(256)), one, True))
    return out


def secret_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, in code points, by start and then kind."""
    found, ends = [], [0] * len(KINDS)
    for folded, automaton, runs in automata():
        view = text.translate(folded).decode("latin-1")
        for last, (n, size) in automaton.iter_long(view) if runs else automaton.iter(view):
            at = last + 1 - size
            if at < ends[n]:
                continue
            m = KINDS[n].pattern.match(text, at)
            if m:
                ends[n] = m.end()
                if KINDS[n].right(m):
                    found.append((at, n, m.end()))
    if not found:
        return []
    found.sort()
    points, seen, chars = {}, 0, 0
    for place in sorted({x for at, _, end in found for x in (at, end)}):
        chars += len(text[seen:place].decode("utf-8"))
        seen = place
        points[place] = chars
    return [(KINDS[n].name, points[at], points[end]) for at, n, end in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_in(text: Column) -> Column:
    """The spans of secrets in a text, as an array of SPANS."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = ([dict(zip(("kind", "start", "end"), x)) for x in secret_spans(t.as_py() or b"")] for t in texts.cast(pa.binary()))
            yield pa.array(rows, _SPANS)

    return scan(text)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with their spans."""
    columns = [c for c in docs.columns if c.lower() != "spans"]
    return unpacked(as_rows(docs).withColumn("found", spans_in(F.col("row.text"))), columns + ["spans"], spans=F.col("found"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of their texts, or each row of spans that overlap, replaced by its first kind in brackets."""
    rows = as_rows(docs).withColumn("found", spans_in(F.col("row.text")))
    text = F.col("row.text")

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        cut = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.when(fresh, cut).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("found", first, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647))))
    return unpacked(rows, docs.columns, text=F.when(F.size("found") > 0, clean).otherwise(text))


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _matches(kind: str, pattern: str) -> str:
    return f"SELECT rid, '{kind}' AS kind, {[k.name for k in KINDS].index(kind)} AS n, string_split(regexp_replace(x, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM t"


_BYTES = "list_transform(range(1, 31), lambda i: ascii(substr(m, len(m) - 36 + i, 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"
_TAIL = f"list_aggregate(list_transform([5, 4, 3, 2, 1, 0], lambda p: substr('{BASE62}', 1 + (({_CRC} // (62 ** p)::BIGINT) % 62)::INT, 1)), 'string_agg', '')"
_LUHN = "list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(g, i, 1)::INT ELSE 2 * substr(g, i, 1)::INT - CASE WHEN substr(g, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

OP11_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, replace(replace(coalesce(text, ''), chr(1), '~'), chr(2), '~') AS x FROM documents
), p AS (
  {_matches("assign", r'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["' + "''" + r']?\x20*[:=]\x20*["' + "''" + r']?([A-Za-z0-9+/_.=-]+)')}
  UNION ALL {_matches("access", "AKIA[A-Z0-9]+")}
  UNION ALL {_matches("hex", "[0-9a-f]+")}
  UNION ALL {_matches("github", r"\bgh[pousr]_[0-9A-Za-z]{36}\b")}
  UNION ALL {_matches("npm", r"\bnpm_[0-9A-Za-z]{36}\b")}
  UNION ALL {_matches("card", r"\b(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4})\b")}
), u AS (
  SELECT rid, kind, n, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM p WHERE len(parts) > 1
), w AS (
  SELECT rid, kind, n, i, split_part(part, chr(2), 1) AS m,
         sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY rid, kind ORDER BY i) - length(replace(part, chr(2), '')) AS place FROM u
), v AS (
  SELECT rid, kind, n, place::BIGINT AS place, m, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS g FROM w WHERE i > 0
), s AS (
  SELECT rid, kind, n, place, kind || ':' || place || ':' || (place + length(m)) AS span FROM v
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24
             WHEN 'card' THEN {_LUHN} ELSE {_TAIL} = right(m, 6) END
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY place, n) FILTER (n < 3) AS base, string_agg(span, ',' ORDER BY place, n) AS spans FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)
"""
