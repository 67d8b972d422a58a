"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold. The index has
postings (trigram, doc_id) for the trigrams of these queries; postings are intersected and united per document, and
only documents that satisfy a rule's query are verified with its expression. Rules without mandatory trigrams scan all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import columns_but, written


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping, whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    # a run is matched whole from its first possible start, so the least lengths can stand in the expressions
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# the body of a key up to its END line, or without one its header and base64 lines; escaped line ends count as well
UNTIL_END = r"[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
GAP = r"(?:\s|\\[nr])*+"
KEY_LINES = rf"(?:{GAP}(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n\\]*+)*+(?:{GAP}[A-Za-z0-9+/]{{20,}}+={{0,2}}+)*+(?:(?<=[A-Za-z0-9+/]{{20}})\x20*+(?:\r?\n|\\n)[A-Za-z0-9+/]++={{0,2}}+(?=[\t\r\x20]*+(?:\n|\\n|\Z)))?+"
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("browserkey", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----(?:{UNTIL_END}|{KEY_LINES})"),
)
RULES = BASE + MORE


def trigram_query(rule: Rule):
    """("and" | "or", parts) over trigrams in lower case, or None where nothing is mandatory."""

    def joined(op: str, parts: list):
        if op == "or" and any(p is None for p in parts):
            return None
        flat = list(dict.fromkeys(p for p in parts if p is not None))
        return flat[0] if len(flat) == 1 else (op, tuple(flat)) if flat else None

    def of_run(run: str):
        return joined("and", [run[k : k + 3] for k in range(len(run) - 2)])

    def of(tree):
        parts, run = [], ""
        for kind, arg in tree:
            if kind is rc.LITERAL:
                run += chr(arg).lower()
                continue
            if kind is rc.MAX_REPEAT and arg[0] == arg[1] == 1:
                parts.append(of(arg[2]))
            elif kind in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
            elif kind is rc.SUBPATTERN:
                parts.append(of(arg[3]))
            elif kind is rc.BRANCH:
                head = [list(b) for b in arg[1]]
                parts.append(joined("or", [of(b) for b in head]))
            parts.append(of_run(run))
            run = ""
        return joined("and", [*parts, of_run(run)])

    return of(list(rp.parse(rule.pattern)))


def covered(query):
    """The query with fewer trigrams: of a run of overlapping ones every third and the last, which cover its characters.
    Still every match holds them all; what it lets through besides is sorted out when candidates are verified."""
    if query is None or isinstance(query, str):
        return query
    op, parts = query
    if op == "or":
        return op, tuple(covered(p) for p in parts)
    kept, chain = [], []
    for p in [*parts, None]:
        if chain and not (isinstance(p, str) and p[:2] == chain[-1][1:]):
            kept += [t for k, t in enumerate(chain) if k % 3 == 0 or k == len(chain) - 1]
            chain = []
        if isinstance(p, str):
            chain.append(p)
        elif p is not None:
            kept.append(covered(p))
    kept = list(dict.fromkeys(kept))
    return kept[0] if len(kept) == 1 else (op, tuple(kept))


def trigrams_of(query) -> list[str]:
    return [] if query is None else [query] if isinstance(query, str) else [t for p in query[1] for t in trigrams_of(p)]


def postings(docs: DataFrame, grams: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (trigram, doc_id) for the given trigrams, of the lower-cased whole texts."""
    low = F.lower(F.col(text))
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, rules): which rules' queries the postings of a document satisfy. Masks combine before the shuffle."""
    grams = sorted({g for q in queries.values() for g in trigrams_of(q)})
    at = {g: (k // 60, 1 << (k % 60)) for k, g in enumerate(grams)}
    words = range(max((w for w, _ in at.values()), default=-1) + 1)
    bit = {w: F.coalesce(*[F.when(F.col("trigram") == g, F.lit(b)) for g, (x, b) in at.items() if x == w], F.lit(0)) for w in words}
    seen = index.groupBy("doc_id").agg(*[F.bit_or(bit[w]).alias(f"m{w}") for w in words])

    def holds(q) -> Column:
        if isinstance(q, str):
            w, b = at[q]
            return F.col(f"m{w}").bitwiseAND(F.lit(b)) != 0
        out = None
        for p in q[1]:
            one = holds(p)
            out = one if out is None else (out & one if q[0] == "and" else out | one)
        return out

    named = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return seen.select("doc_id", named.alias("rules")).where(F.size("rules") > 0)


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """Array of (start, end, rank, kind) of a rule's matches, in code points."""
    regex = F.lit(rule.regex)
    between = F.transform(F.split(text, rule.regex, -1), lambda s: F.length(s))
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda s: F.length(s)) if rule.group else F.transform(hits, lambda s: F.length(s))
    rows = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), F.transform(hits, lambda s: F.length(s)).alias("size"), sized.alias("part"))
    kind = "struct<start:int,end:int,rank:int,kind:string>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["size"]
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.regex), found).otherwise(F.array().cast(f"array<{kind}>"))


def with_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of spans (start, end, rank, kind) by start, then by the order of the rules.

    Null texts count as empty and have no span. Rows that repeat an id are each verified on their own text; rows
    without id are matched null-safely. Other columns pass through, whatever their names; a column named like the
    result is replaced. An empty table stays empty.
    """
    queries = {r.kind: covered(q) for r in rules if (q := trigram_query(r)) is not None}
    rows = docs.select(columns_but(docs, out).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if queries:
        grams = sorted({g for q in queries.values() for g in trigrams_of(q)})
        found = written(candidates(postings(docs, grams, doc_id, text), queries)).select(F.col("doc_id").alias("found"), "rules")
        rows = rows.join(found, rows["id"].eqNullSafe(found["found"]), "left")
    parts = []
    for rank, r in enumerate(rules):
        spans = spans_of(r, rank, F.col("text"))
        parts.append(F.when(F.array_contains("rules", r.kind), spans).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")) if r.kind in queries else spans)
    # sorted as (start, rank, end, kind)
    ordered = F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return rows.withColumn("spans", ordered).select("row.*", F.col("spans").alias(out))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
