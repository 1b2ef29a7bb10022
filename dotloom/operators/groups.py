"""Counting groups: first neighbours, components, cost, merging and splitting, representatives, counts and labels.

Pair tables have (image_id, i, j) once a pair, i < j, unless they are called directed. Weights and thresholds that the
design leaves open are parameters.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.functions.scalars import bound
from dotloom.sources.store import Kept, kept, scratch


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, other columns kept."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.select("i", "j", *rest).union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: ``df`` is written to the shared folder, where it stays until exit."""
    return kept(df, "cut").df


def bucketed(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """The pairs whose candidates (cand_id, top_class) have the same most likely class."""
    a, b = (top.select(F.col("cand_id").alias(k), F.col("top_class").alias(f"c{k}")) for k in ("i", "j"))
    return pairs.join(a, "i").join(b, "j").where("ci = cj").drop("ci", "cj")


def first_neighbours(pairs: DataFrame, score: str, least: float) -> DataFrame:
    """Edges (image_id, i, j), i < j: each candidate's neighbour of the highest score, the lowest id among equals, if that is at least ``least``."""
    best = both_ways(pairs).groupBy("image_id", "i").agg(F.max_by(F.struct("j", score), F.struct(F.col(score), -F.col("j"))).alias("b")).where(F.col(f"b.{score}") >= least)
    return best.select("image_id", F.least("i", "b.j").alias("i"), F.greatest("i", "b.j").alias("j")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (image_id, cand_id) with ``group_id``, the least cand_id of the node's component.

    Least labels spread along the edges, and labels follow their own label, until none falls; a round is a join on the
    node, so a large image or group is dealt over tasks.
    """
    both = kept(both_ways(edges.select("i", "j").where("i <> j").distinct()), "edges")
    label = kept(nodes.select("image_id", "cand_id", F.col("cand_id").alias("group_id")), "labels")
    while True:
        at = label.df.select(F.col("cand_id").alias("j"), F.col("group_id").alias("theirs"))
        near = both.df.join(at, "j").groupBy(F.col("i").alias("cand_id")).agg(F.min("theirs").alias("near"))
        hooked = label.df.join(near, "cand_id", "left").select("image_id", "cand_id", F.col("group_id").alias("old"), F.least("group_id", F.coalesce("near", "group_id")).alias("group_id"))
        up = hooked.select(F.col("cand_id").alias("group_id"), F.col("group_id").alias("upper"))
        new = kept(hooked.join(up, "group_id", "left").select("image_id", "cand_id", "old", F.least("group_id", F.coalesce("upper", "group_id")).alias("group_id")), "labels")
        label.drop()
        label = new
        if new.df.where("group_id <> old").isEmpty():
            both.drop()
            return new.df.select("image_id", "cand_id", "group_id")


# ---------------------------------------------------------------- group states
KEY = ["image_id", "group_id"]


@dataclass(frozen=True)
class Weights:
    """What the design leaves open: the best class's share below which a candidate is noise, the cost of a group, the floor of an affinity."""

    noise_below: float = 0.5
    complexity: float = 0.1
    eps: float = 1e-6


@dataclass
class Groups:
    """Groups and what their costs add up from.

    ``members`` (image_id, cand_id, group_id); ``states`` (image_id, group_id, n, noisy, classes, sums, loose, pairs, away):
    candidates, noisy ones, number of classes, sums of p and z behind each other, sum of -log(affinity + eps) and number of
    the pairs inside, and sum of the distances of z from its mean; ``between`` (image_id, a, b, loose, pairs) for groups
    a < b that some pair joins. The state of two groups as one is the sum of theirs and of what is between them, but for
    ``away``, which needs the members.
    """

    members: Kept
    states: Kept
    between: Kept
    pairs: Kept | None = None

    def joined(self, w: Weights) -> Kept:
        """``_joined``, written once."""
        if self.pairs is None:
            self.pairs = kept(_joined(self, w), "pairs")
        return self.pairs

    def drop(self) -> None:
        for t in (self.members, self.states, self.between, self.pairs):
            if t:
                t.drop()


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))


def _centre(s: Column) -> Column:
    """The mean z of a state."""
    return F.transform(F.slice(s["sums"], s["classes"] + 1, F.size(s["sums"])), lambda v: v / s["n"])


def _terms(s: Column, w: Weights) -> dict[str, Column]:
    """The cost terms of a state but its dispersion."""
    share = F.transform(F.slice(s["sums"], F.lit(1), s["classes"]), lambda v: v / s["n"])
    entropy = -F.aggregate(share, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, v * F.log(v)).otherwise(0.0))
    total = s["n"] * (s["n"] - 1) / 2
    # Pairs without affinity count eps.
    loose = F.coalesce(F.try_divide(s["loose"] - (total - s["pairs"]) * F.log(F.lit(w.eps)), total), F.lit(0.0))
    return {"entropy": entropy, "inconsistency": loose, "noise": s["noisy"] / s["n"]}


def _plain_cost(s: Column, w: Weights) -> Column:
    t = _terms(s, w)
    return t["entropy"] + t["inconsistency"] + t["noise"] + w.complexity


def _met(members: DataFrame, pairs: DataFrame, weights: Weights) -> DataFrame:
    """(image_id, a, b, loose, pairs) of the pairs inside a group (a = b) and between two."""
    g = lambda c, x: members.select(F.col("cand_id").alias(c), F.col("group_id").alias(x), *(["image_id"] if c == "i" else []))
    met = pairs.select("i", "j", "affinity").join(g("i", "gi"), "i").join(g("j", "gj"), "j")
    return met.groupBy("image_id", F.least("gi", "gj").alias("a"), F.greatest("gi", "gj").alias("b")).agg(F.sum(-F.log(F.col("affinity") + weights.eps)).alias("loose"), F.count("*").alias("pairs"))


def grouped(members: DataFrame, features: DataFrame, pairs: DataFrame, weights: Weights) -> Groups:
    """Groups of ``members`` (image_id, group_id, cand_id), ``features`` (cand_id, p, z, valid) and ``pairs`` (i, j, affinity)."""
    own = kept(members.select("image_id", "cand_id", "group_id"), "members")
    unsure = (F.coalesce(F.col("valid"), F.lit(0)) <= 0) | (F.array_max("p") < weights.noise_below)
    m = own.df.join(features.select("cand_id", "z", F.concat("p", "z").alias("v"), F.size("p").alias("classes"), unsure.cast("long").alias("noisy")), "cand_id")
    m = kept(m, "features")
    # A sum for each place: no row for each value is exchanged.
    width = m.df.agg(F.max(F.size("v"))).first()[0] or 0
    sums = F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(width)]).cast("array<double>")
    n = m.df.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("noisy").alias("noisy"), F.max("classes").alias("classes"), F.slice(sums, F.lit(1), F.max(F.size("v"))).alias("sums")).where("sums IS NOT NULL")
    sizes = kept(n, "sizes")
    n = sizes.df
    centre = n.select(*KEY, _centre(F.struct("n", "sums", "classes")).alias("c"))
    away = m.df.join(centre, KEY).groupBy(*KEY).agg(F.sum(_distance(F.col("z"), F.col("c"))).alias("away"))
    met = kept(_met(own.df, pairs, weights), "met")
    inside = met.df.where("a = b").select("image_id", F.col("a").alias("group_id"), "loose", "pairs")
    states = n.join(away, KEY).join(inside, KEY, "left").select(*KEY, "n", "noisy", "classes", "sums", F.coalesce("loose", F.lit(0.0)).alias("loose"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "away")
    out = Groups(own, kept(states, "states"), kept(met.df.where("a < b"), "between"))
    for t in (m, sizes, met):
        t.drop()
    return out


STATE = ("n", "noisy", "classes", "sums", "loose", "pairs", "away")


def state_costs(states: DataFrame, weights: Weights) -> DataFrame:
    """The cost terms of each group and their sum."""
    s = F.struct(*STATE)
    t = _terms(s, weights)
    d = states.select(*KEY, "n", *[v.alias(k) for k, v in t.items()], (F.col("away") / F.col("n")).alias("dispersion"))
    cost = F.col("entropy") + F.col("inconsistency") + F.col("dispersion") + F.col("noise") + weights.complexity
    return d.select(*KEY, "n", "entropy", "inconsistency", "dispersion", "noise", cost.alias("cost"))


def costs(members: DataFrame, features: DataFrame, pairs: DataFrame, **weights: float) -> DataFrame:
    """The cost terms of each group and their sum.

    A pair without affinity counts eps. Terms: entropy of the mean distribution; mean of -log(affinity + eps) over pairs,
    0 for a single; mean distance of z from its mean; the share of candidates that are no valid match or whose best class
    is below ``noise_below``; ``complexity`` for each group.
    """
    w = Weights(**weights)
    return state_costs(grouped(members, features, pairs, w).states.df, w)


def _joined(groups: Groups, w: Weights) -> DataFrame:
    """Pairs of groups that could become one: (image_id, a, b, n, centre, plain, before, low, high).

    ``plain`` is the cost of both as one without dispersion, ``before`` that of both apart, ``low`` and ``high`` bound the
    distances' sum ``away`` of both as one: a member's distance from the common mean differs from that from its own by the
    distance of both means at most, and a group's mean distance is no less than that of the means.
    """
    own = F.struct(*STATE)
    s = groups.states.df.withColumns({"centre": _centre(own), "cost": _plain_cost(own, w) + F.col("away") / F.col("n")})
    s = s.select("image_id", "group_id", F.struct(*STATE, "centre", "cost").alias("s"))
    side = lambda x: s.select("image_id", F.col("group_id").alias(x), F.col("s").alias(f"s{x}"))
    d = groups.between.df.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])
    x, y = F.col("sa"), F.col("sb")
    both = F.struct(
        (x["n"] + y["n"]).alias("n"), (x["noisy"] + y["noisy"]).alias("noisy"), x["classes"].alias("classes"), F.zip_with(x["sums"], y["sums"], lambda u, v: u + v).alias("sums"),
        (x["loose"] + y["loose"] + F.col("loose")).alias("loose"), (x["pairs"] + y["pairs"] + F.col("pairs")).alias("pairs"),
    )
    low = lambda t, m: F.greatest(t["away"] - t["n"] * m, t["n"] * m)
    high = lambda t, m: t["away"] + t["n"] * m

    def of(s, centre, m):
        return F.struct(
            s["n"].alias("n"), centre.alias("centre"), _plain_cost(s, w).alias("plain"), (x["cost"] + y["cost"]).alias("before"), (low(x, m["a"]) + low(y, m["b"])).alias("low"), (high(x, m["a"]) + high(y, m["b"])).alias("high")
        )

    # Sums, means and their distances are computed once a pair: as columns they would be written out again wherever they are used.
    moves = lambda c: F.struct(_distance(x["centre"], c).alias("a"), _distance(y["centre"], c).alias("b"))
    r = bound(both, lambda s: bound(_centre(s), lambda c: bound(moves(c), lambda m: of(s, c, m))))
    return d.select("image_id", "a", "b", r.alias("r")).select("image_id", "a", "b", "r.*")


def _ends(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair of groups once for either: (image_id, g, o, columns)."""
    return pairs.select("image_id", F.inline(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))), *columns)


def _gains(groups: Groups, features: DataFrame, w: Weights, least: float | None) -> DataFrame:
    """(image_id, a, b, away, gain) of pairs of groups; with ``least`` only of those that can be the best of either and gain more.

    Members meet the means of the pairs that their group is in, in one row each; distances are added up before the exchange.
    """
    some = groups.joined(w).df
    if least is not None:
        gain = lambda away: F.col("before") - F.col("plain") - F.col(away) / F.col("n")
        bounds = some.select("image_id", "a", "b", gain("low").alias("most"), gain("high").alias("sure")).where(F.col("most") > least - 1e-9)
        floor = _ends(bounds, "sure").groupBy("image_id", "g").agg(F.max("sure").alias("floor"))
        best = _ends(bounds, "most").join(floor, ["image_id", "g"]).where(F.col("most") >= F.col("floor") - 1e-9)
        chosen = best.select("image_id", F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b")).distinct()
        some = some.join(chosen, ["image_id", "a", "b"])
    centres = some.select("image_id", F.explode(F.array("a", "b")).alias("group_id"), F.struct("a", "b", "centre").alias("c")).groupBy(*KEY).agg(F.collect_list("c").alias("centres"))
    m = groups.members.df.join(features.select("cand_id", "z"), "cand_id").join(centres, KEY)
    far = F.transform("centres", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), _distance(F.col("z"), c["centre"]).alias("d")))
    away = m.select("image_id", F.inline(far)).groupBy("image_id", "a", "b").agg(F.sum("d").alias("away"))
    out = some.join(away, ["image_id", "a", "b"]).select("image_id", "a", "b", "away", (F.col("before") - F.col("plain") - F.col("away") / F.col("n")).alias("gain"))
    return out


def merge_gains(members: DataFrame, features: DataFrame, pairs: DataFrame, **weights: float) -> DataFrame:
    """(image_id, a, b, gain) of the pairs of groups that some pair of candidates joins: Cost(a) + Cost(b) - Cost(both)."""
    w = Weights(**weights)
    return _gains(grouped(members, features, pairs, w), features, w, None).drop("away")


def _mutual(gains: DataFrame, least: float) -> DataFrame:
    """(image_id, a, b, and what else ``gains`` has) of the pairs that are each other's best gain above ``least``, the lower id among equals; a < b."""
    rest = [c for c in gains.columns if c not in ("image_id", "a", "b")]
    best = _ends(gains.where(F.col("gain") > least), *rest).groupBy("image_id", "g").agg(F.max_by(F.struct("o", *rest), F.struct("gain", -F.col("o"))).alias("s"))
    pairs = best.groupBy("image_id", F.least("g", "s.o").alias("a"), F.greatest("g", "s.o").alias("b")).agg(F.count("*").alias("ends"), F.first("s").alias("s"))
    return pairs.where("ends = 2").select("image_id", "a", "b", *[f"s.{c}" for c in rest])


def _after(groups: Groups, chosen: DataFrame) -> Groups:
    """The groups of the images that have chosen pairs (image_id, a, b, away), after these became one each, under the lower id."""
    images = chosen.select("image_id").distinct()
    of = lambda t: t.df.join(images, "image_id", "left_semi")
    gone = chosen.select("image_id", F.col("b").alias("group_id"), F.col("a").alias("into"))
    new = lambda d, key: d.join(gone.withColumnRenamed("group_id", key), ["image_id", key], "left").withColumn(key, F.coalesce("into", key)).drop("into")
    between = new(new(of(groups.between), "a"), "b")
    between = between.groupBy("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("loose").alias("loose"), F.sum("pairs").alias("pairs"))
    inner = chosen.select("image_id", "a", "b", F.col("away").alias("common")).join(groups.between.df, ["image_id", "a", "b"]).select("image_id", F.col("a").alias("group_id"), "common", F.col("loose").alias("more"), F.col("pairs").alias("met"))
    states = new(of(groups.states), "group_id").groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("noisy").alias("noisy"), F.max("classes").alias("classes"), F.collect_list("sums").alias("all"), F.sum("loose").alias("loose"), F.sum("pairs").alias("pairs"), F.sum("away").alias("away"),
    )
    sums = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.zip_with(F.col("all")[0], F.try_element_at("all", F.lit(2)), lambda u, v: u + v))
    states = states.join(inner, KEY, "left").select(
        *KEY, "n", "noisy", "classes", sums.alias("sums"), (F.col("loose") + F.coalesce("more", F.lit(0.0))).alias("loose"), (F.col("pairs") + F.coalesce("met", F.lit(0))).alias("pairs"), F.coalesce("common", "away").alias("away"),
    )
    members = new(of(groups.members), "group_id").select("image_id", "cand_id", "group_id")
    out = Groups(kept(members, "members"), kept(states, "states"), kept(between.where("a < b"), "between"))
    groups.drop()
    return out


def merged(members: DataFrame, gains: DataFrame, least: float = 1e-9) -> DataFrame:
    """One round of merging: pairs of groups that are each other's best gain above ``least`` become one (the lower id)."""
    mutual = _mutual(gains, least).select("image_id", F.col("b").alias("group_id"), F.col("a").alias("o"))
    return members.join(mutual, ["image_id", "group_id"], "left").select("image_id", "cand_id", F.coalesce("o", "group_id").alias("group_id"))


def split(members: DataFrame, features: DataFrame, pairs: DataFrame, least: float, most_entropy: float = 1.0, most_inconsistency: float = 1.0, **weights: float) -> DataFrame:
    """Groups of high entropy or inconsistency fall into their components at the higher affinity ``least``, where that lowers the total cost."""
    return _divided(members, features, pairs, Weights(**weights), least, most_entropy, most_inconsistency).members.df


def _divided(members: DataFrame, features: DataFrame, pairs: DataFrame, w: Weights, least: float, most_entropy: float = 1.0, most_inconsistency: float = 1.0) -> Groups:
    """``split``, with the states: each group's is computed once, that of a part where its group is bad."""
    whole = grouped(members, features, pairs, w)
    c = state_costs(whole.states.df, w)
    bad = kept(c.where((F.col("entropy") > most_entropy) | (F.col("inconsistency") > most_inconsistency)).select(*KEY, "cost"), "bad")
    inside = kept(whole.members.df.join(bad.df.select(*KEY), KEY, "left_semi"), "inside")
    g = lambda c: inside.df.select(*KEY, F.col("cand_id").alias(c))
    own = kept(g("i").join(pairs.select("i", "j", "affinity"), "i").join(g("j"), [*KEY, "j"]).select("image_id", "i", "j", "affinity"), "own")
    parts = grouped(components(inside.df.select("image_id", "cand_id"), first_neighbours(own.df, "affinity", least)), features, own.df, w)
    cost = state_costs(parts.states.df, w).select("image_id", F.col("group_id").alias("part"), F.col("cost").alias("part_cost"))
    of = parts.members.df.select("image_id", "cand_id", F.col("group_id").alias("part")).join(inside.df, ["image_id", "cand_id"])
    sums = of.select(*KEY, "part").distinct().join(cost, ["image_id", "part"]).groupBy(*KEY).agg(F.sum("part_cost").alias("after"))
    moved = kept(of.join(bad.df.join(sums, KEY).where("after < cost").select(*KEY), KEY), "moved")
    now = whole.members.df.join(moved.df.select("image_id", "cand_id", "part"), ["image_id", "cand_id"], "left").select("image_id", "cand_id", F.coalesce("part", "group_id").alias("group_id"))
    gone, new = moved.df.select(*KEY).distinct(), moved.df.select("image_id", F.col("part").alias("group_id")).distinct()
    states = whole.states.df.join(gone, KEY, "left_anti").unionByName(parts.states.df.join(new, KEY, "left_semi"))
    now = kept(now, "members")
    out = Groups(now, kept(states, "states"), kept(_met(now.df, pairs, w).where("a < b"), "between"))
    for t in (whole, parts, bad, inside, own, moved):
        t.drop()
    return out


def isolated(members: DataFrame, features: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Adds ``noise``: a group of one candidate whose best class is below ``confidence``."""
    n = members.groupBy("image_id", "group_id").agg(F.count("*").alias("n"))
    p = features.select("cand_id", F.array_max("p").alias("best"))
    return members.join(n, ["image_id", "group_id"]).join(p, "cand_id").select("image_id", "cand_id", "group_id", ((F.col("n") == 1) & (F.col("best") < confidence)).alias("noise"))


def refined(members: DataFrame, features: DataFrame, pairs: DataFrame, split_least: float, confidence: float = 0.5, least: float = 1e-9, limits: dict | None = None, **weights: float) -> DataFrame:
    """Splits groups (by the ``limits`` of ``split``), merges pairs of groups until none gains, then marks noise.

    A round merges all pairs that are each other's best; each merge lowers an image's number of groups, so the rounds end.
    A round's tables replace those of the one before, and hold the images alone in which groups still merge.
    """
    w = Weights(**weights)
    groups = _divided(members, features, pairs, w, split_least, **(limits or {}))
    path, schema, ended = scratch(members.sparkSession, "refined"), groups.members.df.schema, False
    while not ended:
        chosen = kept(_mutual(_gains(groups, features, w, least), least), "chosen")
        # An image without a chosen pair has none in any later round.
        groups.members.df.join(chosen.df.select("image_id").distinct(), "image_id", "left_anti").write.mode("append").parquet(path)
        ended = chosen.df.isEmpty()
        if ended:
            groups.drop()
        else:
            groups = _after(groups, chosen.df)
        chosen.drop()
    return isolated(members.sparkSession.read.schema(schema).parquet(path), features, confidence)


# ---------------------------------------------------------------- counting
def representative_scores(parts: DataFrame, features: DataFrame, directed: DataFrame) -> DataFrame:
    """Adds ``rep_score`` to ``parts`` (image_id, group_id, comp_id, cand_id).

    ``features`` (cand_id, confidence, completeness); ``directed`` (i, j, a_part, iou), both directions. Means over the
    component's other members, 0 without any; the penalty is the highest IoU with a more confident one.
    """
    c = parts.select("comp_id", "cand_id").join(features.select("cand_id", "confidence"), "cand_id")
    a, b = c.select("comp_id", F.col("cand_id").alias("i"), F.col("confidence").alias("ci")), c.select("comp_id", F.col("cand_id").alias("j"), F.col("confidence").alias("cj"))
    inside = a.join(directed, "i").join(b, ["comp_id", "j"])
    size = parts.groupBy("comp_id").agg((F.count("*") - 1).alias("others"))
    out = inside.groupBy(F.col("i").alias("cand_id")).agg(F.sum("a_part").alias("outgoing"), F.max(F.when((F.col("cj") > F.col("ci")) | ((F.col("cj") == F.col("ci")) & (F.col("j") < F.col("i"))), F.col("iou"))).alias("penalty"))
    come = inside.groupBy(F.col("j").alias("cand_id")).agg(F.sum("a_part").alias("incoming"))
    d = parts.join(size, "comp_id").join(features, "cand_id").join(out, "cand_id", "left").join(come, "cand_id", "left")
    mean = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("others")), F.lit(0.0))
    score = F.col("confidence") + F.col("completeness") + mean("incoming") - mean("outgoing") - F.coalesce("penalty", F.lit(0.0))
    return d.select(*parts.columns, score.alias("rep_score"))


def representatives(scored: DataFrame, digits: int = 6) -> DataFrame:
    """The candidate with the highest ``rep_score`` (to ``digits`` places) of each component, the lowest id among equals."""
    best = F.max_by("cand_id", F.struct(F.round("rep_score", digits).alias("r"), -F.col("cand_id")))
    return scored.groupBy("image_id", "group_id", "comp_id").agg(best.alias("cand_id"))


def without_parts(reps: DataFrame, directed: DataFrame, least: float = 0.8) -> DataFrame:
    """Representatives that are no part (a_part at least ``least``) of a larger representative of their group; ``directed`` has (i, j, a_part, larger)."""
    a, b = reps.select("group_id", F.col("cand_id").alias("i")), reps.select("group_id", F.col("cand_id").alias("j"))
    part = a.join(directed.where(F.col("larger") & (F.col("a_part") >= least)), "i").join(b, ["group_id", "j"]).select(F.col("i").alias("cand_id")).distinct()
    return reps.join(part, "cand_id", "left_anti")


def group_counts(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(image_id, group_id, n_candidates, count): representatives of each group, 0 where none is left."""
    n = members.groupBy("image_id", "group_id").agg(F.count("*").alias("n_candidates"))
    k = reps.groupBy("image_id", "group_id").agg(F.count("*").alias("count"))
    return n.join(k, ["image_id", "group_id"], "left").fillna(0, ["count"])


def group_labels(reps: DataFrame, probs: DataFrame, counts: DataFrame, least: float = 0.5, background: list[int] | None = None) -> DataFrame:
    """Adds ``class_idx``, ``confidence`` and ``kind`` of each group from its representatives' mean distribution.

    kind: object; unknown_repeated_pattern or unknown_object below ``least`` (by more than one representative or one);
    background for those classes; a group without representatives has class -1 and is unknown_object.
    """
    p = reps.join(probs.select("cand_id", "p"), "cand_id").select("image_id", "group_id", F.posexplode("p").alias("k", "v"))
    mean = p.groupBy("image_id", "group_id", "k").agg(F.avg("v").alias("v"))
    top = mean.groupBy("image_id", "group_id").agg(F.max_by(F.struct("k", "v"), F.struct("v", -F.col("k"))).alias("t"))
    d = counts.join(top, ["image_id", "group_id"], "left")
    sure = F.coalesce(F.col("t.v"), F.lit(0.0))
    kind = F.when((sure < least) & (F.col("count") > 1), "unknown_repeated_pattern").when(sure < least, "unknown_object").when(F.col("t.k").isin(background or []), "background").otherwise("object")
    return d.select(*counts.columns, F.coalesce(F.col("t.k"), F.lit(-1)).cast("long").alias("class_idx"), sure.alias("confidence"), kind.alias("kind"))


def result_json(labels: DataFrame) -> DataFrame:
    """(image_id, result): the groups of an image as JSON, in the order of their ids."""
    g = F.struct(F.col("group_id"), F.col("class_idx"), F.col("kind"), F.col("count"))
    return labels.groupBy("image_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(g)).alias("groups"))).alias("result"))
