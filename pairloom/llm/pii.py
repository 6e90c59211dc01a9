"""Personal data: fixed formats, and identifiers found through their context.

The fixed formats (mail addresses, IP addresses, card and phone numbers) are searched in
every text. Further identifiers are bootstrapped: seed entities, which are the fixed
formats and long hexadecimal keys, induce lexical patterns (the words around them).
Patterns and the shapes of the instances they surround form a weighted graph over the
whole corpus. Trust flows from seed shapes to patterns and back for a few rounds; the
instances of patterns that end with high confidence are reported as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "id"

# The formats, with possessive repeats where giving back could never help, so that the
# time is linear in the text.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S++")
_SIGNS = re.compile(r"[\W_]*+")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{24,}")

#: An instance that is not a fixed format has at least so many characters and digits.
MIN_LENGTH, MIN_DIGITS = 6, 4
#: A longer shape or context word is shown up to here, followed by a hash of the whole.
MAX_SHAPE = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ is tried once: the run of name characters before it, the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed formats as (kind, start, end) in code points, by kind and start. A match
    that fails its check is dropped and not tried again further on."""
    out = [("email", a, b) for a, b in _emails(text)] if text and "@" in text else []
    if not text or not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _short(node: str) -> str:
    """A name of bounded length that different nodes do not share."""
    if len(node) <= MAX_SHAPE:
        return node
    return f"{node[:MAX_SHAPE]}#{hashlib.blake2b(node.encode(errors='surrogatepass'), digest_size=16).hexdigest()}"


def _shape(token: str) -> str:
    if _HEX.fullmatch(token):
        return f"hex:{len(token)}"
    return _short(re.sub(r"([9aA])\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", token)))))


def _word(token: str) -> str:
    """A context word: lower case, digits alike."""
    return _short(re.sub(r"[0-9]+", "9", token.lower()))


def instances(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple]:
    """Identifiers inside their tokens, as (start, end, shape, seed, patterns).

    Signs around an identifier are not part of it; the nearest one on either side belongs
    to its patterns. Two patterns: the two words before it, and one word on either side; ``^``
    stands for the start of the text. A token that touches a base span stands for that
    span's kind and is a seed.
    """
    if not text or not (base or _DIGIT.search(text)):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    spans = sorted((a, b, kind) for kind, a, b in base)
    out, k = [], 0
    for i, (a, b) in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        kind = spans[k][2] if k < len(spans) and spans[k][0] < b else None
        token = text[a:b]
        left = _SIGNS.match(token).end()
        inner = token[left : max(left, len(token) - _SIGNS.match(token[::-1]).end())]
        if kind is None and (len(inner) < MIN_LENGTH or len(_DIGIT.findall(inner)) < MIN_DIGITS):
            continue
        before = [_word(text[x:y]) for x, y in tokens[max(0, i - 2) : i]] or ["^"]
        after = _word(text[slice(*tokens[i + 1])]) if i + 1 < len(tokens) else ""
        edge = token[max(0, left - 1) : left] + "_" + token[left + len(inner) : left + len(inner) + 1]
        patterns = [f"{' '.join(before)} {edge}", f"{before[-1]} {edge} {after}"]
        shape = f"base:{kind}" if kind else _shape(inner)
        out.append((a + left, a + left + len(inner), shape, bool(kind) or shape.startswith("hex:"), patterns))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_INSTANCE = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("shape", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]
)
FOUND = (
    "base array<struct<kind:string,start:int,end:int>>, "
    "instances array<struct<start:int,end:int,shape:string,seed:boolean,patterns:array<string>>>"
)


def _search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        base, seen = [], []
        for value in column:
            text = value.as_py()
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            keys = ("start", "end", "shape", "seed", "patterns")
            seen.append([dict(zip(keys, x, strict=True)) for x in instances(text, spans)])
        yield pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_INSTANCE))], names=["base", "instances"])


def score_patterns(edges: DataFrame, rounds: int = 3, doubt: float = 3.0) -> DataFrame:
    """Trust of each pattern from the graph ``pattern, shape, seed, weight``.

    A pattern's trust is the weighted mean trust of its shapes, with ``doubt`` untrusted
    occurrences added, so rare patterns stay low. A shape's trust is 1 for seeds, else the
    weighted mean trust of its patterns. Each round is two sums before a shuffle.
    """
    shapes = edges.groupBy("shape").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    patterns = None
    for k in range(rounds):
        patterns = stored(
            edges.join(shapes, "shape")
            .groupBy("pattern")
            .agg((F.sum(F.col("weight") * F.col("trust")) / (F.sum("weight") + doubt)).alias("confidence")),
            f"patterns-{k}",
        )
        shapes = (
            edges.join(patterns, "pattern")
            .groupBy("shape")
            .agg(
                F.greatest(
                    F.max(F.col("seed").cast("double")), F.sum(F.col("weight") * F.col("confidence")) / F.sum("weight")
                ).alias("trust")
            )
        )
    return patterns


def find_personal_data(
    docs: DataFrame, text_col: str = "text", min_confidence: float = 0.75, rounds: int = 3
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` (so any names may occur); ``base``, the
    fixed formats; ``found``, the spans discovered through context, which never overlap a
    base span. Each is an array of ``kind, start, end`` in order.

    Null and empty texts have no spans. Repeated rows are searched each on its own and
    support a pattern once each. Positions are code points, ends are exclusive.
    """
    search = F.arrow_udf(_search, FOUND).asNondeterministic()
    rows = docs.select(F.struct("*").alias("row")).withColumn("_f", search(F.col("row").getField(text_col)))
    keep = F.col("row").dropFields(text_col) if len(docs.columns) > 1 else F.struct(F.lit(None).alias(text_col))
    scanned = stored(
        rows.select(keep.alias("row"), F.monotonically_increasing_id().alias("_n"), "_f.base", "_f.instances"), "personal-data"
    )
    seen = scanned.select("_n", F.explode("instances").alias("i")).select("_n", "i.*")
    links = seen.select("_n", "start", "end", "shape", "seed", F.explode("patterns").alias("pattern"))
    edges = stored(
        links.groupBy("pattern", "shape").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).cast("double").alias("weight")),
        "pattern-graph",
    )
    trusted = score_patterns(edges, rounds).filter(F.col("confidence") >= min_confidence).select("pattern")
    hits = (
        links.filter(~F.startswith("shape", F.lit("base:")))
        .join(trusted, "pattern")
        .groupBy("_n")
        .agg(F.array_sort(F.collect_set(F.struct(F.lit(DISCOVERED).alias("kind"), "start", "end"))).alias("found"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(hits, "_n", "left").select("row", "base", F.coalesce("found", none).alias("found"))


def span_text(spans: Column) -> Column:
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
