"""Rows and joins of everyday use: floors, validation, redaction, leak search, precedence, shared items, keypoint tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.graph import connected_components
from skerry.plans.prefix import running_totals
from skerry.plans.skew import hot_keys, skew_join
from skerry.runtime import Scratch


def at_least(df: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose value reaches a floor; null and NaN do not."""
    return df.filter((F.col(column) >= least) & ~F.isnan(F.col(column).cast("double")))


def inside_image(df: DataFrame, x: str, y: str, width: str, height: str) -> DataFrame:
    """Rows whose position lies within its image, the far edges outside. A null in any of the four is outside."""
    return df.filter((F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(x) < F.col(width)) & (F.col(y) < F.col(height)))


def validated(df: DataFrame, rules: Mapping[str, Column], out: str = "problems") -> DataFrame:
    """Adds the names of all rules a row breaks; a rule that is null counts as broken."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])))


def scrubbed(df: DataFrame, maps: Sequence[str], withheld: Sequence[str]) -> DataFrame:
    """Map columns without withheld keys, whatever their case. Null maps stay null."""
    gone = F.array(*[F.lit(w.lower()) for w in withheld])
    return df.withColumns({m: F.map_filter(m, lambda k, v: ~F.array_contains(gone, F.lower(k))) for m in maps})


def numbers_in(text: Column) -> Column:
    """Numbers that a text holds, as written: whole parts and decimals. A number is not looked for inside a longer one."""
    runs = F.filter(F.regexp_extract_all(text, F.lit("[0-9.]+"), F.lit(0)), lambda r: F.substring(r, 1, 1) != ".")
    whole = F.transform(runs, lambda r: F.substring_index(r, ".", 1))
    dec = F.transform(F.filter(runs, lambda r: r.rlike(r"^[0-9]+\.[0-9]")), lambda r: F.substring_index(r, ".", 2))
    return F.array_distinct(F.concat(whole, dec))


def leaks(texts: DataFrame, key: str, text: str, scope: str, readings: DataFrame, form: str) -> DataFrame:
    """Texts that hold a withheld reading of their scope as a number of its own: ``key, scope, form``.

    Numbers are taken out of each text once and meet the readings by an equi-join on (scope, form), instead of a search of
    every text for every reading.
    """
    said = Scratch(texts.sparkSession).write(texts.filter(F.col(scope).isNotNull()).select(key, scope, F.explode(numbers_in(F.col(text))).alias(form)))
    known = readings.select(scope, form).dropna().distinct()
    return skew_join(said.df, known, [scope, form], "inner", hot_keys(said.df, [scope, form], said.rows)).select(key, scope, form)


def with_pairs(matches: DataFrame, pairs: DataFrame, key: str = "pair_idx") -> DataFrame:
    """Matches with the images of their pair; of repeated pairs the smallest row counts. Matches without a pair have nulls."""
    s = Scratch(matches.sparkSession)
    cols = [c for c in pairs.columns if c != key]
    one = pairs.dropna(subset=[key]).groupBy(key).agg(F.min(F.struct(*cols)).alias("_p")).select(key, "_p.*")
    m = s.keep(matches)
    return skew_join(m.df, one, [key], "left", hot_keys(m.df, [key], m.rows))


def preferred(df: DataFrame, key: Sequence[str], sources: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Columns from the first source that has them for a key: left joins in order of precedence. Sources have a row per key."""
    key, out = list(key), df
    for i, s in enumerate(sources):
        out = out.join(s.select(*key, *[F.col(c).alias(f"_{i}_{c}") for c in columns]), key, "left")
    return out.select(*df.columns, *[F.coalesce(*[F.col(f"_{i}_{c}") for i in range(len(sources))]).alias(c) for c in columns])


def _seen(obs: DataFrame, scope: Sequence[str], frame: str, item: str) -> DataFrame:
    return obs.select(*scope, F.col(item).alias("_i"), F.col(frame).alias("_f")).dropna().distinct()


def shared_by_pairs(obs: DataFrame, scope: Sequence[str], frame: str, item: str) -> DataFrame:
    """``scope, a, b, shared``: how many items frames a < b have in common. An item meets each of its frames once, so pairs
    of an item are bounded by the frames of its scope."""
    scope, o = list(scope), _seen(obs, scope, frame, item)
    b = o.withColumnRenamed("_f", "b")
    return o.withColumnRenamed("_f", "a").join(b, [*scope, "_i"]).filter("a < b").groupBy(*scope, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def shared_by_triples(obs: DataFrame, scope: Sequence[str], frame: str, item: str) -> DataFrame:
    """``scope, a, b, c, shared``: items that three frames a < b < c have in common."""
    scope, o = list(scope), _seen(obs, scope, frame, item)
    f = lambda n: o.withColumnRenamed("_f", n)
    on = [*scope, "_i"]
    return f("a").join(f("b"), on).filter("a < b").join(f("c"), on).filter("b < c").groupBy(*scope, "a", "b", "c").agg(F.count(F.lit(1)).alias("shared"))


def held_out(df: DataFrame, left: str, right: str) -> DataFrame:
    """Matches that do not lie on one point at both ends: all but those whose ends name the same point."""
    return df.filter(~F.coalesce((F.col(left) == F.col(right)) & (F.col(left) >= 0), F.lit(False)))


def endpoints(links: DataFrame) -> DataFrame:
    """Both ends of links ``scope, seq, i, j, fi, fj, xi, yi, xj, yj`` as rows ``scope, image, feature, x, y, seq, side``."""
    side = lambda k, n: F.struct(F.col(k).alias("image"), F.col(f"f{k}").alias("feature"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.lit(n).alias("side"))
    return links.select("scope", "seq", F.explode(F.array(side("i", 0), side("j", 1))).alias("e")).select("scope", "e.*", "seq").dropna(subset=["scope", "image", "feature"])


def node_table(links: DataFrame, sides_last: bool = True) -> DataFrame:
    """``scope, image, feature, x, y``: each keypoint where it was written last.

    With ``sides_last`` all first ends come before all second ends, else ends of one link follow each other. Links in order
    of ``seq``.
    """
    order = F.struct("side", "seq") if sides_last else F.struct("seq", "side")
    return endpoints(links).groupBy("scope", "image", "feature").agg(F.max_by(F.struct("x", "y"), order).alias("p")).select("scope", "image", "feature", "p.*")


def keypoint_rows(links: DataFrame) -> DataFrame:
    """Endpoints of links without feature numbers as keypoints of their own: ``scope, image, row, seq, side``; rows of an
    image count from 0 in order of seq, then side. By running totals, so an image of any size is fine."""
    e = links.select("scope", "seq", F.explode(F.array(*[F.struct(F.col(k).alias("image"), F.lit(n).alias("side")) for n, k in enumerate("ij")])).alias("e")).select("scope", "e.image", "seq", "e.side").dropna()
    got, _ = running_totals(e.withColumn("_one", F.lit(1)), ["scope", "image"], ["seq", "side"], "_one", "row", Scratch(links.sparkSession))
    return got.select("scope", "image", F.col("row").cast("bigint").alias("row"), "seq", "side")


def first_seen_ids(df: DataFrame, scope: Sequence[str], cell: Sequence[str], order: str, out: str) -> DataFrame:
    """Distinct cells of each scope, numbered 0, 1, ... in the order in which they come first."""
    scope, s = list(scope), Scratch(df.sparkSession)
    firsts = df.dropna(subset=[*scope, *cell]).groupBy(*scope, *cell).agg(F.min(order).alias("_o"))
    got, _ = running_totals(firsts.withColumn("_one", F.lit(1)), scope, ["_o", *cell], "_one", out, s)
    return got.select(*scope, *cell, F.col(out).cast("bigint").alias(out))


def multiview_fraction(links: DataFrame, least: int = 3) -> DataFrame:
    """Share of linked groups of keypoints (``scope, i, fi, j, fj``) that span ``least`` images or more, by scope."""
    s = Scratch(links.sparkSession)
    ok = s.write(links.select("scope", "i", "fi", "j", "fj").dropna().distinct())
    ends = ok.df.select("scope", F.explode(F.array(F.struct(F.col("i").alias("image"), F.col("fi").alias("feature")), F.struct(F.col("j").alias("image"), F.col("fj").alias("feature")))).alias("e")).select("scope", "e.*").distinct()
    ids = s.write(ends.withColumn("node", F.monotonically_increasing_id()))
    at = lambda i, n: ids.df.select("scope", F.col("image").alias(i), F.col("feature").alias(f"f{i}"), F.col("node").alias(n))
    edges = ok.df.join(at("i", "src"), ["scope", "i", "fi"]).join(at("j", "dst"), ["scope", "j", "fj"]).select("src", "dst")
    groups = connected_components(edges).join(ids.df, "node").groupBy("scope", "component").agg((F.count_distinct("image") >= least).alias("multi"))
    return s.settle(groups.groupBy("scope").agg(F.count(F.lit(1)).alias("groups"), F.count_if("multi").alias("multiview"), F.avg(F.col("multi").cast("double")).alias("fraction")), ok, ids)


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int, out: str = "chunk") -> DataFrame:
    """Rows of each group in runs of ``size``, in order; ``order`` is unique within a group."""
    got, _ = running_totals(df.dropna(subset=list(group)).withColumn("_one", F.lit(1)), list(group), list(order), "_one", "_at", Scratch(df.sparkSession))
    return got.withColumn(out, F.floor(F.col("_at") / size).cast("bigint")).drop("_one", "_at")


def steps_between(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str = "gap") -> DataFrame:
    """Adds the difference from the row before in the group; null for the first row and beside nulls."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def canonical(tokens: DataFrame, token: str, corpus: DataFrame, key: str, aliases: Mapping[str, str] | None = None, families: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the corpus key (``family/leaf``) that each token names, or null.

    An alias counts first; a token with a slash names its family (by its alias in ``families``) and leaf; a bare token names
    the leaf that only one key of the corpus has.
    """
    t = F.trim(F.col(token))
    keys = corpus.select(F.col(key).alias("_key")).dropna().distinct()
    leaf = keys.groupBy(F.substring_index("_key", "/", -1).alias("_leaf")).agg(F.min("_key").alias("_only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    pick = lambda m, c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c] if m else F.lit(None).cast("string")
    fam = pick(families, F.lower(F.substring_index(t, "/", 1)))
    named = F.coalesce(pick(aliases, t), F.when(t.contains("/"), F.concat(fam, F.lit("/"), F.substring_index(t, "/", -1))))
    out = tokens.withColumn("_named", named).withColumn("_bare", F.when(F.col("_named").isNull() & ~t.contains("/") & (t != ""), t))
    out = out.join(keys.withColumnRenamed("_key", "_hit"), F.col("_named") == F.col("_hit"), "left").join(leaf, F.col("_bare") == F.col("_leaf"), "left")
    return out.withColumn(key, F.coalesce("_hit", "_only")).drop("_named", "_bare", "_hit", "_leaf", "_only")


def under_entries(df: DataFrame, path: str, entries: DataFrame, entry: str) -> DataFrame:
    """Adds the longest entry that the path lies under, by whole segments, or null. Joined on all leading parts of the path,
    not by trying every entry."""
    segs = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    n = F.size(segs)
    parts = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, n), lambda b: F.concat_ws("/", F.slice(segs, a, b - a + 1))))))
    src = df.select(path).dropna().distinct()
    hit = src.select(path, F.explode(parts).alias("_e")).join(entries.select(F.regexp_replace(F.trim(F.col(entry)), "^/+|/+$", "").alias("_e")).filter("_e <> ''").distinct(), "_e")
    return df.join(hit.groupBy(path).agg(F.max_by("_e", F.struct(F.length("_e"), "_e")).alias(entry)), path, "left")


def enough(kept: Column, original: Column, share: float) -> Column:
    """Whether enough of an original set is kept: ``ceil(share of it)``, one at least; an empty or null set is."""
    o = F.array_distinct(F.coalesce(original, F.array().cast("array<string>")))
    return (F.size(o) == 0) | (F.size(F.array_intersect(o, F.coalesce(kept, F.array().cast("array<string>")))) >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.size(o))))


def map_changes(left: Column, right: Column) -> Column:
    """Keys on which two maps differ, sorted; a key on one side only differs, a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)) | (F.map_contains_key(a, k) != F.map_contains_key(b, k))))


def exif_seconds(c: Column) -> Column:
    """Seconds since 1970 of ``2024:05:01 12:30:00``; null for anything else."""
    return F.unix_timestamp(F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss")))


def significant(c: Column, digits: int = 6) -> Column:
    """Rounded to significant digits; null, NaN, infinities and 0 stay."""
    m = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c.isNull() | F.isnan(c) | (c == 0) | (F.abs(c) == float("inf")), c).otherwise(F.rint(c * m) / m)
