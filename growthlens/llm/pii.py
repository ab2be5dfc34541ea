"""Personal data in texts: candidate spans, boosted trees over format and context, calibrated thresholds.

SQL functions only. Base spans follow fixed rules per kind. Two generators with high recall propose further spans that
may overlap: anything around an @, and runs of digits with separators. Boosted trees, trained by Spark ML on the
proposals of all texts with the base rules as labels, score each proposal; they see its shape and what stands around it,
not the rule. One half of the texts trains the trees, on the other half a threshold is calibrated per kind; proposals
above it that touch no base span are added. The trees are applied as column expressions, so a text is scored in place, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm.shared import kept

# What each kind looks like. Possessive repeats and the marks in front of a run keep matching linear on
# long texts; they accept the same spans as the plain patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

#: Generators of proposals: anything around an @, and digits with up to two separators between them.
PROPOSALS = {
    "email": r"(?:\G|(?<![^\s<>()\[\]\x22',;:@]))[^\s<>()\[\]\x22',;:@]++@[^\s<>()\[\]\x22',;:@]++",
    "number": r"[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9])++",
}
PROPOSAL_HINTS = {"email": "@", "number": "[0-9]"}
CONTEXT = 12
CLASSES = ("email", "ip", "card", "phone")
BLOCK = 256


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _running_sums(values: Column) -> Column:
    """Sums up to and including each element, by blocks, so that long arrays don't cost the square of their length."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int"))
    whole = F.transform(blocks, lambda b: _sum(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def within(before: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(before, block) + _sum(F.slice(values, block * BLOCK + 1, i - block * BLOCK + 1))

        return F.transform(values, at)

    return let(whole, lambda w: let(F.transform(w, lambda x, i: _sum(F.slice(w, F.lit(1), i))), within))


def matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<begin, stop, part>> of the leftmost non-overlapping matches, in code points from 0."""

    def placed(parts: Column, begins: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            begin = F.get(begins, i).cast("int")
            return F.struct(begin.alias("begin"), (begin + F.char_length(p)).alias("stop"), p.alias("part"))

        return F.transform(parts, one)

    def steps(parts: Column, gaps: Column) -> Column:
        """How far each match begins behind the begin of the one before."""
        return F.transform(parts, lambda p, i: F.get(gaps, i) + F.when(i > 0, F.char_length(F.get(parts, i - 1))).otherwise(0))

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda parts: let(gaps, lambda g: let(steps(parts, g), lambda d: let(_running_sums(d), lambda b: placed(parts, b)))),
    )
    none = F.array().cast("array<struct<begin:int,stop:int,part:string>>")
    return F.when(text.rlike(hint), found).otherwise(none)


def digits(part: Column) -> Column:
    return F.regexp_replace(part, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _holds(kind: str, part: Column) -> Column:
    """The rule that a match of the kind's pattern must pass."""
    if kind == "ip":
        # longer parts are too large even where they don't fit a number
        fits = lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(part, r"\."), lambda p: fits(p) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.char_length(digits(part))
        return F.when((n >= 14) & (n <= 19), luhn(digits(part))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(part)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<begin, order, stop>> of all kinds by begin, then kind."""
    def of(order: int, kind: str) -> Column:
        held = F.filter(matches(text, PATTERNS[kind], HINTS[kind]), lambda m: _holds(kind, m["part"]))
        return F.transform(held, lambda m: F.struct(m["begin"].alias("begin"), F.lit(order).alias("order"), m["stop"].alias("stop")))

    return F.array_sort(F.concat(*(of(order, kind) for order, kind in enumerate(KINDS))))


FEATURES = ("size", "digits", "letters", "dots", "hyphens", "spaces", "brackets", "plus", "at", "groups", "checksum", "glued", "followed", "quoted", "keyed", "large_part")


def proposals(text: Column) -> Column:
    """array<struct<begin, order, stop, features array<double>>>; order is the kind that a proposal would be."""

    def count(part: Column, of: str) -> Column:
        return F.char_length(part) - F.char_length(F.regexp_replace(part, of, ""))

    def described(m: Column, family: str) -> Column:
        part, n = m["part"], F.char_length(digits(m["part"]))
        before = F.substring(text, F.greatest(m["begin"] - CONTEXT + 1, F.lit(1)), F.least(m["begin"], F.lit(CONTEXT)))
        after = F.substring(text, m["stop"] + 1, F.lit(2))
        parts = F.filter(F.split(part, "[^0-9]+"), lambda p: p != "")
        number = lambda c: c.cast("double")
        values = [
            F.char_length(part), n, count(part, "[A-Za-z]"), count(part, r"\."), count(part, "-"), count(part, " "), count(part, "[()]"),
            count(part, r"\+"), count(part, "@"), F.size(parts), F.when(n.between(14, 19), luhn(digits(part))).otherwise(False),
            before.rlike("[A-Za-z0-9_]$"), after.rlike("^[A-Za-z0-9_]"), before.rlike("[\"'=]\\s*$"), before.rlike("(?i)(mail|tel|phone|card|call|ip)\\W*$"),
            F.exists(parts, lambda p: (F.char_length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255)),
        ]
        dotted = part.rlike(r"^[0-9]+(\.[0-9]+){3}$")
        order = F.lit(0) if family == "email" else F.when(dotted, F.lit(1)).when(n >= 14, F.lit(2)).otherwise(F.lit(3))
        return F.struct(m["begin"].alias("begin"), order.alias("order"), m["stop"].alias("stop"), F.array(*map(number, values)).alias("features"))

    def of(family: str) -> Column:
        return F.transform(matches(text, PROPOSALS[family], PROPOSAL_HINTS[family]), lambda m: described(m, family))

    return F.concat(*map(of, PROPOSALS))


@dataclass
class Trees:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, and the least score for each kind."""

    trees: list
    thresholds: list[float]

    def score(self, features: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(features, F.lit(feature)) <= threshold, value(left)).otherwise(value(right))

        margin = F.lit(0.0)
        for weight, node in self.trees:
            margin = margin + F.lit(weight) * value(node)
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, proposal: Column) -> Column:
        least = F.get(F.array(*map(F.lit, self.thresholds)), proposal["order"])
        return self.score(proposal["features"]) >= least


def _tree(node) -> object:
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _touches(spans: Column, begin: Column, stop: Column) -> Column:
    return F.exists(spans, lambda s: (s["begin"] < stop) & (s["stop"] > begin))


def train(docs: DataFrame, *, rounds: int = 8, depth: int = 3, precision: float = 0.99) -> Trees:
    """Trees from all rows. A proposal counts as personal data if it is a base span. The trees learn from the proposals of
    one half of the ids, by a hash; every kind gets the least threshold at which those of the other half reach
    `precision`. None of a kind is accepted if no threshold does, or if the first half has only one class.

    Equal proposals are counted before the shuffle and weighted by their number, so what the trees read grows with the
    number of different shapes. Null texts propose nothing.
    """
    text = F.col("text")
    spans = docs.where(text.rlike("[0-9@]")).select("doc_id", base_spans(text).alias("base"), proposals(text).alias("proposed"))

    def labelled(p: Column) -> Column:
        same = F.exists("base", lambda s: (s["begin"] == p["begin"]) & (s["stop"] == p["stop"]))
        return F.struct(same.cast("double").alias("label"), p["order"].alias("order"), p["features"].alias("features"))

    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    each = spans.select(half, F.explode(F.transform("proposed", labelled)).alias("p")).select("half", "p.*")
    counted = kept(each.groupBy("half", "label", "order", "features").agg(F.count("*").cast("double").alias("times")))
    names = [f"f{i}" for i in range(len(FEATURES))]
    first = counted.where("half = 0").select("label", "features", "times", *(F.get("features", F.lit(i)).alias(x) for i, x in enumerate(names)))
    never = Trees([], [2.0] * len(CLASSES))
    if first.select("label").distinct().count() < 2:
        return never
    assembled = VectorAssembler(inputCols=names, outputCol="vector").transform(first)
    fitter = GBTClassifier(featuresCol="vector", weightCol="times", maxIter=rounds, maxDepth=depth, seed=7, checkpointInterval=-1)
    model = fitter.fit(assembled)
    trees = Trees([(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)], never.thresholds)
    bins = counted.where("half = 1").select("order", "label", "times", F.floor(trees.score(F.col("features")) * 100).alias("bin"))
    counts = bins.groupBy("order", "bin").agg(F.sum(F.col("label") * F.col("times")).alias("good"), F.sum("times").alias("all")).collect()
    for order in range(len(CLASSES)):
        good = total = 0
        for row in sorted((r for r in counts if r["order"] == order), key=lambda r: -r["bin"]):
            good, total = good + row["good"], total + row["all"]
            if good < precision * total:
                break
            trees.thresholds[order] = row["bin"] / 100
    return trees


def listed(spans: Column) -> Column:
    """kind:begin:stop of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    said = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["begin"].cast("string"), s["stop"].cast("string")))
    return F.array_join(said, ",")


def find(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with base and spans, arrays of struct<begin, order, stop>: order numbers the kinds of KINDS, positions are
    code points, the end is exclusive. spans holds the base spans and the accepted proposals that touch none of them.

    Null and empty texts have no spans. Columns of these names are replaced; all others are kept.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<begin:int,order:int,stop:int>>")
    possible = text.rlike("[0-9@]")
    found = docs.drop("base", "spans").withColumn("base", F.when(possible, base_spans(text)).otherwise(none))
    free = F.filter(proposals(text), lambda p: ~_touches(F.col("base"), p["begin"], p["stop"]) & trees.accepts(p))
    added = F.transform(free, lambda p: F.struct(p["begin"].alias("begin"), p["order"].alias("order"), p["stop"].alias("stop")))
    return found.withColumn("spans", F.when(possible, F.array_sort(F.array_distinct(F.concat("base", added)))).otherwise(F.col("base")))


def redact(found: DataFrame) -> DataFrame:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one names the stretch."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["begin"] - done["at"], F.lit(0)))
        parts = F.concat(done["parts"], F.array(gap, F.get(names, s["order"])))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.when(s["begin"] < done["at"], done["parts"]).otherwise(parts).alias("parts"))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))

    clean = F.aggregate("spans", start, step, finish)
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
