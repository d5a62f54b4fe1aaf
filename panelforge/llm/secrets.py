"""Secret scans: pattern spans, and weak parts of credentials that are linked within a scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``part``: i(dentifier), s(ecret) or e(ndpoint).  ``needs``: regular expressions of which a text must hold
    one, else the pattern is not tried.  ``value``: a match counts only if its end matches this."""

    name: str
    pattern: str
    part: str
    base: bool = False
    needs: tuple[str, ...] = ()
    least: int = 0
    value: str = ""


_VALUE = "[A-Za-z0-9+/_.=-]"

#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("assign", rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}+)""", "s", True, (":", "="), 6),
    Kind("access", "AKIA[A-Z0-9]+", "i", True, ("AKIA",), 20),
    Kind("hex", "[0-9a-f]{24,}", "s", True),
    Kind("ident", r"""(?i:access_?(?:key_?)?id|client_?id|user_?(?:name|id)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "i", False, (":", "=")),
    Kind("secret", "[A-Za-z0-9+/_=-]{16,}", "s", False, ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"), 0, "^(?=.*[0-9])(?=.*[A-Za-z])"),
    Kind("endpoint", r"""https?://[^\x00-\x20"'<>]+|(?<![0-9A-Za-z_])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9A-Za-z_])""", "e", False, ("://", ".")),
)


def _found(text: Column, kind: Kind) -> Column:
    """The leftmost non-overlapping matches of a kind."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if not kind.needs:
        return found
    some = F.contains(text, F.lit(kind.needs[0]))
    for n in kind.needs[1:]:
        some = some | F.contains(text, F.lit(n))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def _matches(text: Column, found: Column, at: int, kind: Kind) -> Column:
    """Of each match of a kind: number, length of the gap before, length, and whether it counts.

    Gaps come from splitting by the same pattern, so that positions are running sums of lengths.
    """
    gaps = F.when(F.size(found) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))

    def counts(match: Column) -> Column:
        if kind.name == "assign":
            return F.char_length(F.regexp_extract(match, kind.pattern, 1)) >= kind.least
        if kind.value:
            return match.rlike(kind.value)
        return F.char_length(match) >= kind.least

    both = F.zip_with(found, gaps, lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), counts(m).alias("ok")))
    real = F.filter(both, lambda x: x["len"].isNotNull())  # the gap after the last match has none
    return F.transform(real, lambda x, i: F.struct(F.lit(at).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))


def scan(docs: DataFrame, scope: int = 300, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: the key, ``spans`` (start, kind number, kind, end, base, ident, secret; code points, end
    exclusive; by start, then kind) and a count of each base kind, ``n_<kind>``.

    Base kinds (assign, access, hex) are reported as they match.  The weak kinds (ident,
    secret, endpoint) are only parts of a credential, reported when complementary parts lie within ``scope`` code points
    (start to start) in the same document: for an identifier a secret, for a secret an identifier, for an endpoint both.
    Base spans count as parts.  The same characters never count twice: a weak span is no part, and is not reported, if it
    overlaps a base span, nor an identifier that overlaps an endpoint, nor a secret that overlaps either of them; and an
    assignment or hex string that overlaps an access id is reported but is no complement of others.
    ``ident`` and ``secret`` link a span to the starts of its nearest complements within the scope (the earlier of two
    as near), null where there is none.

    The interval join runs as windows over the parts of a document in order, each of which looks at the rows before or
    behind the current one only: linear in the parts, however dense they are.

    Texts are matched whole in one narrow pass; one shuffle then carries the matches'
    lengths, never text.  A null text counts as empty.  Rows that repeat key and text
    each get a row; null keys are kept; an empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    body = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    one = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok")))
    body = body.withColumns({f"_{k.name}": _found(F.col("_text"), k) for k in KINDS})
    found = F.concat(one, *[_matches(F.col("_text"), F.col(f"_{k.name}"), at, k) for at, k in enumerate(KINDS)])
    items = body.select("_key", F.xxhash64("_text").alias("_hash"), F.explode(found).alias("m")).select("_key", "_hash", "m.*")
    doc = ["_key", "_hash"]
    items = items.repartition(*doc).groupBy(*doc, "kind", "i", "gap", "len", "ok").agg(F.count(F.lit(1)).alias("times"))

    upto = Window.partitionBy(*doc, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = items.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).where("ok OR kind < 0")

    named = lambda of: F.element_at(F.array(*[F.lit(of(k)) for k in KINDS]), F.greatest(F.col("kind"), F.lit(0)) + 1)
    real = F.col("kind") >= 0
    parts = placed.withColumn("part", F.when(real, named(lambda k: k.part))).withColumn("base", F.when(real, named(lambda k: k.base)).otherwise(F.lit(False)))
    before = Window.partitionBy(*doc).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*doc).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def clear_of(blocker: Column) -> Column:
        last, following = F.max(F.when(blocker, F.col("end"))).over(before), F.min(F.when(blocker, F.col("start"))).over(behind)
        return (F.coalesce(last, F.lit(-1)) <= F.col("start")) & F.coalesce(following >= F.col("end"), F.lit(True))

    kind = lambda name: F.col("kind") == [k.name for k in KINDS].index(name)
    parts = parts.withColumns({"_a": clear_of(kind("access")), "_b": clear_of(F.col("base"))})
    parts = parts.withColumn("_e", clear_of(kind("endpoint") & F.col("_b")))
    parts = parts.withColumn("_i", clear_of(kind("ident") & F.col("_b") & F.col("_e")))
    weak = F.col("_b") & F.when(kind("endpoint"), F.lit(True)).when(kind("ident"), F.col("_e")).otherwise(F.col("_e") & F.col("_i"))
    parts = parts.withColumn("counts", real & F.when(kind("access"), F.lit(True)).when(F.col("base"), F.col("_a")).otherwise(weak))

    def nearest(part: str) -> Column:
        is_one = F.when(F.col("counts") & (F.col("part") == part), F.col("start"))
        reach = lambda w: F.last(is_one, ignorenulls=True).over(w)
        left, right = reach(before), reach(behind)
        left = F.when(F.col("start") - left <= scope, left)
        right = F.when(right - F.col("start") <= scope, right)
        return F.when(left.isNull() | (right - F.col("start") < F.col("start") - left), F.coalesce(right, left)).otherwise(left)

    linked = parts.withColumns({"_ident": nearest("i"), "_secret": nearest("s")})
    linked = linked.withColumns({"_ident": F.when(F.col("counts") & (F.col("part") != "i"), F.col("_ident")), "_secret": F.when(F.col("counts") & (F.col("part") != "s"), F.col("_secret"))})
    complete = (F.col("part") == "i") & F.col("_secret").isNotNull() | (F.col("part") == "s") & F.col("_ident").isNotNull() | F.col("_ident").isNotNull() & F.col("_secret").isNotNull()
    kept = F.col("base") | (F.col("counts") & complete)

    span = F.struct("start", "kind", named(lambda k: k.name).alias("name"), "end", "base", F.col("_ident").alias("ident"), F.col("_secret").alias("secret"))
    out = linked.groupBy(*doc).agg(
        F.sort_array(F.collect_list(F.when(real & kept, span))).alias("spans"),
        *[F.count(F.when((F.col("kind") == at), F.lit(1))).alias(f"n_{k.name}") for at, k in enumerate(KINDS) if k.base],
        F.max(F.when(F.col("kind") < 0, F.col("times"))).alias("_times"),
    )
    # Rows that repeat key and text were one so far.
    out = out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(F.col("_key").alias(key), "spans", *[f"n_{k.name}" for k in KINDS if k.base])


def linked_pairs(spans: Column) -> Column:
    """Of spans, which identifier and which secret each belongs to, as ``kind:start>ident:secret``, comma-joined."""
    some = F.filter(spans, lambda s: s["ident"].isNotNull() | s["secret"].isNotNull())
    start = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_join(F.transform(some, lambda s: F.concat(s["name"], F.lit(":"), s["start"].cast("string"), F.lit(">"), start(s["ident"]), F.lit(":"), start(s["secret"]))), ",")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
