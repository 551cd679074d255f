"""URL filtering: host and path rules first, gradient-boosted trees for the rest.

Trees are grown on lexical features (lengths, depth, digit ratio, entropy, parameter counts,
suffix statistics) of labelled URLs. Features, histograms and scores are column expressions
and DataFrame aggregations; the driver sees sums for each (node, feature, bin) only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows that are learnt from at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: A suffix has a statistic of its own from so many labelled rows on; so there are
#: SAMPLE_ROWS / SUFFIX_ROWS suffixes at most.
SUFFIX_ROWS = 50
BINS, DEPTH, TREES, RATE, L2 = 12, 3, 8, 0.4, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for null and for URLs without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits (null without). A rule fits its host and
    all subdomains where the path starts with the rule's."""
    name = action = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        action = F.when(fits, r.action) if action is None else action.when(fits, r.action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), action.otherwise(none))


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for the empty text."""
    n = F.length(text)

    def part(acc: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
        return acc + k * F.log2(k)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.log2(n.cast("double")) - F.aggregate(chars, F.lit(0.0), part) / n).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The host's last two labels: the part whose statistics are learnt."""
    return F.substring_index(host, ".", -2)


FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "params", "fragment", "suffix_rate")


def lexical(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host, path and the lexical features (a null URL counts as empty)."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("__host"), F.col("__path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    df = df.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    n = F.greatest(F.length(u), F.lit(1))
    return df.withColumns({
        "__length": F.length(u).cast("double"),
        "__host_length": F.length(host).cast("double"),
        "__labels": _count(host, ".").cast("double"),
        "__depth": _count(path, "/").cast("double"),
        "__digit_ratio": _count(u, "0123456789") / n,
        "__host_digits": _count(host, "0123456789").cast("double"),
        "__hyphens": _count(host, "-").cast("double"),
        "__entropy": F.round(entropy(u), 6),
        "__params": F.when(query == "", 0.0).otherwise((_count(query, "&") + 1).cast("double")),
        "__fragment": F.when(F.contains(u, F.lit("#")), 1.0).otherwise(0.0),
        "__suffix": suffix_of(host),
    })


@dataclass
class Model:
    """Additive trees on raw features: log-odds of the label 1."""

    prior: float
    suffixes: dict[str, float] = field(default_factory=dict)
    trees: list[dict] = field(default_factory=list)

    def with_suffix(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__suffix_rate", self.rate(self.suffixes))

    def rate(self, suffixes: dict[str, float]) -> Column:
        """The share of label 1 that is known of a row's suffix, or else of all rows."""
        base = F.lit(1 / (1 + math.exp(-self.prior)))
        if not suffixes:
            return base
        known = F.create_map(*[F.lit(x) for kv in sorted(suffixes.items()) for x in kv])
        return F.coalesce(F.try_element_at(known, F.col("__suffix")), base)

    def margin(self) -> Column:
        out = F.lit(self.prior)
        for t in self.trees:
            out = out + _tree(t)
        return out


def _tree(t: dict) -> Column:
    if "leaf" in t:
        return F.lit(t["leaf"])
    return F.when(F.col(f"__{t['feature']}") > t["above"], _tree(t["right"])).otherwise(_tree(t["left"]))


def train(labelled: DataFrame, url: str, label: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trees from labelled URLs (label 0 or 1; rows with a null label are left out).

    Learns from the ``sample_rows`` rows with the smallest hashes. Without labels, or with
    one label only, the model is its smoothed prior.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("__url"), F.col(label).cast("double").alias("__y"))
    rows = rows.orderBy(F.xxhash64("__url", "__y"), "__url", "__y").limit(sample_rows)
    rows = lexical(rows, "__url").withColumn("__half", F.pmod(F.xxhash64(F.lit("half"), "__url"), F.lit(2)))
    rows = materialize(rows.drop("__url", "__path", "__host"), "url-sample")
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("__y"), F.lit(0.0))).first()
    prior = math.log((pos + 1) / (n - pos + 1))
    model = Model(prior)
    if not 0 < pos < n:
        return model
    p = pos / n
    # trees learn from rates that don't know the row itself: those of the other half of the rows
    half = F.col("__half") == 0
    own = [f(F.when(half == side, x)).alias(f"{n}{int(side)}") for side in (True, False) for n, f, x in (("n", F.count, F.lit(1)), ("k", F.sum, F.col("__y")))]
    stats = rows.groupBy("__suffix").agg(*own).where(F.col("n1") + F.col("n0") >= SUFFIX_ROWS).collect()
    smooth = lambda k, n: ((k or 0) + 10 * p) / (n + 10)
    model.suffixes = {r["__suffix"]: smooth((r["k1"] or 0) + (r["k0"] or 0), r["n1"] + r["n0"]) for r in stats}
    other = [model.rate({r["__suffix"]: smooth(r[f"k{i}"], r[f"n{i}"]) for r in stats}) for i in (0, 1)]
    rows = rows.withColumn("__suffix_rate", F.when(half, other[0]).otherwise(other[1]))
    at = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(f"__{f}", at, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    # rows of equal bins are one: all boosting runs over their counts
    binned = rows.select(*[sum(((F.col(f"__{f}") > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES], "__y")
    binned = materialize(binned.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("k")), "url-bins")

    def on_bins(t: dict) -> Column:
        if "leaf" in t:
            return F.lit(t["leaf"])
        return F.when(F.col(t["feature"]) > t["bin"], on_bins(t["right"])).otherwise(on_bins(t["left"]))

    def node_of(t: dict) -> Column:
        if "split" not in t:
            return F.lit(t["node"])
        return F.when(F.col(t["feature"]) > t["bin"], node_of(t["right"])).otherwise(node_of(t["left"]))

    margin = F.lit(prior)
    for _ in range(TREES):
        prob = 1 / (1 + F.exp(-margin))
        slopes = binned.withColumns({"g": F.col("k") - F.col("n") * prob, "h": F.col("n") * prob * (1 - prob)})
        root: dict = {"node": 0}
        open_nodes, made = [root], 1
        for _ in range(DEPTH):
            if not open_nodes:
                break
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(FEATURES)]))
            sums = slopes.select(node_of(root).alias("node"), "g", "h", each.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            grown = []
            for t in open_nodes:
                t |= _best(hist.get(t["node"], {}), cuts)
                if "split" in t:
                    for side in ("left", "right"):
                        t[side] |= {"node": made}
                        grown.append(t[side])
                        made += 1
            open_nodes = grown
        _finish(root)
        model.trees.append(root)
        margin = margin + on_bins(root)
    return model


def _gain(g: float, h: float) -> float:
    return g * g / (h + L2)


def _best(hist: dict[int, dict[int, tuple[float, float]]], cuts: dict[str, list[float]]) -> dict:
    """The split of a node with the largest gain (ties: the first feature, the lowest bin)."""
    best: tuple[float, dict] = (1e-3, {})
    g = h = 0.0
    for f in sorted(hist):
        bins = hist[f]
        g, h = sum(x[0] for _, x in sorted(bins.items())), sum(x[1] for _, x in sorted(bins.items()))
        lg = lh = 0.0
        for b in sorted(bins)[:-1]:
            lg, lh = lg + bins[b][0], lh + bins[b][1]
            if lh < 1 or h - lh < 1:
                continue
            won = round(_gain(lg, lh) + _gain(g - lg, h - lh) - _gain(g, h), 6)
            if won > best[0]:
                leaf = lambda a, c: {"value": RATE * a / (c + L2)}
                best = (won, {"split": won, "feature": FEATURES[f], "bin": b, "above": float(cuts[FEATURES[f]][b]), "left": leaf(lg, lh), "right": leaf(g - lg, h - lh)})
    return best[1] or {"value": RATE * g / (h + L2)}


def _finish(t: dict) -> None:
    if "split" in t:
        _finish(t["left"])
        _finish(t["right"])
    else:
        t["leaf"] = round(t["value"], 9)


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict (``allow`` or ``block``: the rule's, else
    ``block`` where the model's probability is 0.5 at least) and ``p_block``, the model's
    probability. Without a model one is trained on the URLs that rules decide.

    Null URLs, and those without ``://``, have an empty host and path, fit no rule and are
    judged by the model. Repeated rows give repeated results; other columns aren't carried.
    """
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    if model is None:
        host, path = host_of(F.col("__url")), path_of(F.col("__url"))
        decided = matching_rule(host, path, rules)[1]
        model = train(rows.select("__url", (decided == "block").cast("int").alias("__label")), "__url", "__label")
    f = model.with_suffix(lexical(rows, "__url"))
    p = 1 / (1 + F.exp(-model.margin()))
    rule, action = matching_rule(F.col("__host"), F.col("__path"), rules)
    verdict = F.coalesce(action, F.when(p >= 0.5, "block").otherwise("allow"))
    return f.select(key, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.round(p, 6).alias("p_block"))
