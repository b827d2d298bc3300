"""Scalar expressions over text, paths, hashes and numbers. All are Column expressions that Catalyst can fold and push."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The secret shapes that redaction replaces, in order. The third replaces the whole match, so that a bare key does not survive.
SECRETS = [
    (r"(?i)(authorization\s*:\s*bearer\s+)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)\b(password|passwd|token|api[_-]?key|secret|credential)\b\s*[:=]\s*[^\s,;]+", "$1[REDACTED]"),
    (r"\b(sk-[A-Za-z0-9_-]{6,})\b", "[REDACTED]"),
]
#: Phrases that give a machine's text away.
AI_TELLS = [r"(?i)as an ai", r"(?i)i'?m happy to help", r"(?i)great question"]
#: Name parts of files that may hold secrets.
SECRET_NAMES = [".env", "id_rsa", "id_ed25519", "token", "password", "credential", "private_key", "/secret/", "/secrets/"]

#: What a build leaves out: first folders, names anywhere, leading folders.
BUILD_FIRST = [".git", "dist"]
BUILD_NAMES = [".DS_Store", "__MACOSX", "__pycache__"]
BUILD_LEADING = [".ai/cache", ".ai/runtime/.venv", ".ai/runtime/.pytest_cache"]


def stripped(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def candidate_key(candidate: Column, signal: Column, note: Column) -> Column:
    """The candidate, else signal and note, else 'uncategorized'; 120 and 80 characters at most."""
    own = F.nullif(stripped(candidate), F.lit(""))
    other = F.nullif(stripped(F.concat_ws(" ", F.nullif(stripped(signal), F.lit("")), F.nullif(stripped(note), F.lit("")))), F.lit(""))
    return F.coalesce(F.substring(own, 1, 120), F.substring(other, 1, 80), F.lit("uncategorized"))


def word_set(c: Column) -> Column:
    """Distinct lower-cased words of Latin letters, digits, Hangul, _ and -."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9가-힣_-]+)"), 1))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def hits(bag: Column, terms: list[str]) -> Column:
    """How many of the terms are in the bag."""
    return F.size(F.array_intersect(bag, F.array(*[F.lit(t) for t in terms])))


def token_budget(average: Column) -> Column:
    """Rounded up to hundreds, within 400 and 6000."""
    return F.least(F.lit(6000), F.greatest(F.lit(400), F.ceil(average / 100) * 100)).cast("long")


def redacted(c: Column) -> Column:
    """Text without secrets; null becomes empty."""
    out = F.coalesce(c, F.lit(""))
    for pattern, by in SECRETS:
        out = F.regexp_replace(out, pattern, by)
    return out


def absolute_paths_masked(c: Column) -> Column:
    return F.regexp_replace(c, r"(^|[\s\"'=(])/(?:Users|home|root|var|tmp|private)/[^\s\"')]*", "$1[PATH]")


def truncated(c: Column, limit: int = 240) -> Column:
    return F.substring(F.trim(F.translate(c, "\n", " ")), 1, limit)


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; null counts as empty."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c, F.lit("")).rlike(p)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def safe_path(path: Column) -> Column:
    """Relative, without '..' and without metadata members."""
    parts = F.split(path, "/")
    meta = F.exists(parts, lambda p: p.isin("..", "__MACOSX", ".DS_Store") | p.startswith("._"))
    return ~path.startswith("/") & ~meta


def build_excluded(path: Column) -> Column:
    """Whether a build leaves the path out."""
    parts = F.split(path, "/")
    named = F.exists(parts, lambda p: p.isin(BUILD_NAMES) | p.startswith("._"))
    out = F.get(parts, F.lit(0)).isin(BUILD_FIRST) | named
    for folder in BUILD_LEADING:
        out = out | (F.array_join(F.slice(parts, 1, folder.count("/") + 1), "/") == folder)
    return out


def secret_like_path(path: Column) -> Column:
    out = F.lit(False)
    for part in SECRET_NAMES:
        out = out | F.contains(F.lower(path), F.lit(part))
    return out


def private_mode(mode: Column) -> Column:
    """Whether no bit for group or others is set."""
    return mode.bitwiseAND(F.lit(0o077)) == 0


def version_at_least(version: Column, *least: int) -> Column:
    parts = F.split(version, r"\.")
    own = F.struct(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)).try_cast("int"), F.lit(0)) for i in range(len(least))])
    return own >= F.struct(*[F.lit(x) for x in least])


def asset_status(source: Column, installed: Column, absent: str = "would-create") -> Column:
    """missing, unchanged, would-update, or absent, from two content hashes."""
    return F.when(source.isNull(), "missing").when(installed.isNull(), absent).when(source == installed, "unchanged").otherwise("would-update")


def subtokens(token: Column) -> Column:
    """A word and its camel-case parts."""
    return F.array_distinct(F.concat(F.array(F.lower(token)), F.transform(F.regexp_extract_all(token, F.lit("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"), F.lit(0)), F.lower)))


def head_and_tail(text: Column, head: int = 30, tail: int = 5, limit: int = 4096) -> Column:
    """The first and last lines, limit characters at most; shorter texts whole."""
    lines = F.split(text, "\n")
    both = F.concat(F.slice(lines, 1, head), F.slice(lines, -tail, tail))
    return F.substring(F.when(F.size(lines) <= head + tail, text).otherwise(F.array_join(both, "\n")), 1, limit)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def rrf_k(n: Column) -> Column:
    """The fusion constant of a corpus of n documents."""
    return F.greatest(F.lit(30), F.least(F.lit(120), F.round(60 * F.log2(F.greatest(n, F.lit(1))) / F.log2(F.lit(1024))))).cast("int")


def expires(bound: Column) -> Column:
    """A bound as a timestamp: a date lasts through its day, no offset means UTC, anything else is null."""
    day = F.when(bound.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(bound, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss")))
    full = F.when(bound.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"), bound.try_cast("timestamp"))
    return F.coalesce(day, full)


def derived_id(own: Column, *parts: Column) -> Column:
    return F.coalesce(own, F.sha2(F.concat_ws("\u0001", *parts), 256))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def fetch_allowed(url: Column) -> Column:
    """https, and no loopback, private, link-local or metadata address."""
    host = host_of(url)
    octets = F.transform(F.split(F.regexp_extract(host, r"^(\d+\.\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    inner = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    named = host.isin("localhost", "metadata.google.internal", "[::1]") | host.endswith(".local") | host.endswith(".internal")
    return F.lower(url).startswith("https://") & (host != "") & ~F.coalesce(inner, F.lit(False)) & ~named


def metric_value(log: Column) -> Column:
    return F.regexp_extract(log, r"(?m)^metric:\s*([0-9.]+)", 1).try_cast("double")


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of chunks of `size` that share `overlap` with the next, up to the chunk that reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def value_at(v: Column, path: str, kind: str = "string") -> Column:
    """The value of a variant at a dotted path; null where there is none of that type."""
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def first_replaced(text: Column, literal: str, by: str) -> Column:
    """text with the first occurrence of a literal replaced."""
    at = F.instr(text, literal)
    rest = F.substring(text, at + len(literal), F.lit(2147483647))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), rest)).otherwise(text)


def number_in_range(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number within the range; null for an empty string, an error for anything else."""
    x = c.try_cast("double")
    fine = F.coalesce(x.between(low, high), F.lit(False))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("double")).when(fine, x).otherwise(F.raise_error(F.concat(F.lit("not a number in range: "), c)).cast("double"))
