"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: an AND of
clauses, a clause being an OR of literal strings, a string an AND of its trigrams. The index
has a posting (trigram, document) for each trigram of some query that a document contains. Posting lists
are intersected as bit sets by document; a document whose bits satisfy a rule's query is that
rule's candidate. Candidates alone are searched with the rule's expression; rules without a
mandatory trigram search each text.

Candidates are joined back by id: broadcast if their counted number is at most BROADCAST_ROWS, by
shuffle beyond it. Rows with a null id cannot be joined and are candidates of every rule. A null
text counts as empty. Repeated ids share the union of their postings, which only adds candidates. Extra columns stay;
find replaces a column named spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import beside, written

BROADCAST_ROWS = 500_000
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of pattern; those whose group has fewer than least characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules, in the order in which kinds are listed. The first three are the base rules.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


# --- Boolean queries --------------------------------------------------------------


def _strings(items) -> set[str] | None:
    """All strings that a sequence of parsed items can match, if they are few; else None."""
    out = {""}
    for item in items:
        one = _item_strings(item)
        if one is None or len(out) * len(one) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _item_strings(item) -> set[str] | None:
    op, value = item
    if op is sre.LITERAL:
        return {chr(value)}
    if op is sre.IN and len(value) <= 8 and all(kind is sre.LITERAL for kind, _ in value):
        return {chr(v) for _, v in value}
    if op is sre.SUBPATTERN:
        return _strings(value[3])
    if op is sre.BRANCH:
        parts = [_strings(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.MAX_REPEAT:
        least, most, inner = value
        one = _strings(inner)
        if one is not None and most <= 2:
            return set().union(*({"".join([s] * n) for s in one} for n in range(least, int(most) + 1)))
    return None


def _clauses(items) -> list[set[str]]:
    found, run = [], {""}

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            found.append(set(run))

    for item in items:
        one = _item_strings(item)
        if one is not None and len(run) * len(one) <= _MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        close()
        run = one if one is not None else {""}
        op, value = item
        if op is sre.SUBPATTERN and one is None:
            found += _clauses(value[3])
        elif op is sre.MAX_REPEAT and one is None and value[0] >= 1:
            found += _clauses(value[2])
    close()
    return found


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses, each an OR of strings, each an AND of trigrams. Empty: nothing is mandatory."""
    clauses = _clauses(sre_parser.parse(pattern))
    out = []
    for clause in clauses:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in (x.lower() for x in clause)}
        out.append(sorted(sorted(s) for s in sets if not any(t < s for t in sets)))  # a weaker alternative absorbs a stronger one
    return out


# --- index ---------------------------------------------------------------------------


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for alternative in clause for t in alternative})


def postings(docs: DataFrame, grams: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (gram: number in grams, id)."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).where("id is not null")
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(n)) for n, g in enumerate(grams)]))
    return low.select("id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(id, rules: bit set of the rules whose query the id's postings satisfy)."""
    words = range((len(grams) + 61) // 62)
    bits = index.groupBy("id").agg(*[F.bit_or(F.when(F.col("gram").between(62 * w, 62 * w + 61), F.expr(f"shiftleft(1L, gram - {62 * w})")).otherwise(F.lit(0))).alias(f"w{w}") for w in words])
    place = {g: n for n, g in enumerate(grams)}

    def holds(alternative: list[str]) -> Column:
        masks = [sum(1 << (place[g] % 62) for g in alternative if place[g] // 62 == w) for w in words]
        tests = [F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(masks) if m]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    mask = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if not query:
            continue
        match = F.lit(True)
        for clause in query:
            some = holds(clause[0])
            for alternative in clause[1:]:
                some = some | holds(alternative)
            match = match & some
        mask = mask.bitwiseOR(F.when(match, F.lit(1 << n)).otherwise(F.lit(0)))
    return bits.select("id", mask.alias("rules")).where("rules <> 0")


# --- verification ---------------------------------------------------------------------


def _rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end), in code points. A match starts after all pieces and matches before it."""
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["0"])
        end = start + F.length(row["1"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(row["2"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)), hits, tested)
    return F.aggregate(zipped, first, add, lambda s: s["spans"])


def find(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with spans: array of (start, rank, kind, end) by start and rank; ends are exclusive, code points."""
    grams = vocabulary(rules)
    names = [c for c in docs.columns if c != "spans"]
    wanted = written(candidates(postings(docs, grams, id_col=id_col, text_col=text_col), rules, grams), "secret-candidates")
    wanted = wanted.select(F.col("id").alias("_candidate"), F.col("rules").alias("_rules"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    joined = docs.select(*names).join(wanted, docs[id_col] == F.col("_candidate"), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    found = []
    for n, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            look = F.col(id_col).isNull() | (F.coalesce("_rules", F.lit(0).cast("long")).bitwiseAND(F.lit(1 << n)) != 0)
        else:  # one pass over each text; only texts with a long enough match are taken apart
            look = text.rlike(rule.pattern[:-1] + "{%d,}" % rule.least) if rule.pattern.endswith("]+") else text.rlike(rule.pattern)
        found.append(F.when(look, _rule_spans(text, rule, n)).otherwise(nothing))
    return joined.select(*names, F.sort_array(F.flatten(F.array(*found))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by mark (overlapping ones by one mark); nothing else changes, a column named spans included."""
    text = F.col(text_col)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        inside = span["start"] < state["at"]
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).alias("out"))

    clean = F.aggregate("spans", first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return beside(docs, ["spans"], lambda d: find(d, rules=rules, id_col=id_col, text_col=text_col).withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text)))
