"""Building (chosen, rejected) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import values as V
from pairloom.functions.prompts import group_key, passage_text, source_prompt
from pairloom.functions.text import topic_from_name
from pairloom.operators.numbering import draw_within, first_within, number_within, shuffled

CELL_ROWS = 2_000


def common_source_item(high: Column, low: Column, fields: list[str]) -> Column:
    """Fields equal on both sides; types and goals always from the high side."""
    guideline = ("problem_types", "eval_goals")
    return F.struct(
        *[
            (high[f] if f in guideline else F.when(high[f].eqNullSafe(low[f]), high[f])).alias(f)
            for f in fields
        ]
    )


def pair_id(kind: str, rubric: Column, topic: Column, n: Column) -> Column:
    """``<kind>_<rubric>_<topic>_<n>``, the number with at least four digits."""
    return F.format_string(f"{kind}_%s_%s_%04d", rubric, topic, n)


def one_row_each(names: list[str]) -> Column:
    """One row per name, to be selected like any ``explode``."""
    return F.explode(F.array(*[F.lit(n) for n in names]))


def _check_rubrics(rubrics: list[str]) -> None:
    unknown = set(rubrics) - set(V.RUBRICS)
    if unknown:
        raise ValueError(f"unknown rubric {sorted(unknown)}; known are {V.RUBRICS}")


def _side(df: DataFrame, order: list[str], item: str, id: str | None) -> tuple[DataFrame, list[str]]:
    """A side of positional pairs, and the columns that tell its rows apart."""
    side = df.select(
        *([F.col(id).alias("_id")] if id else []),
        group_key(df, item).alias("_key"),
        F.col(item).alias("_item"),
        passage_text(df).alias("_text"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    return side.where(F.col("_key").isNotNull()), ["_id"] if id else ["_key", *[f"_o{i}" for i in range(len(order))]]


def _positional(
    high: DataFrame,
    low: DataFrame,
    rubrics: list[str],
    order: list[str],
    cap: int | None,
    cap_scope: str,
    kind: str,
    created_at: str | None,
    item: str,
    id: str | None,
    spread: bool,
) -> DataFrame:
    _check_rubrics(rubrics)
    fields = high.schema[item].dataType.names
    if fields != low.schema[item].dataType.names:
        raise ValueError("both sides need the same source item fields")
    per_key = cap if cap_scope == "key" else None
    by = [F.col(f"_o{i}") for i in range(len(order))]

    def numbered(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Numbered ids, and the columns that they stand for."""
        side, own = _side(df, order, item, id)
        ids = side.select(*dict.fromkeys(["_key", *[f"_o{i}" for i in range(len(order))], *own]))
        at = F.struct(*own).alias(f"_{name}")
        found = first_within(ids, ["_key"], by, per_key, spread=spread).select("_key", "pos", at)
        return found, side.select(at, F.col("_item").alias(f"_{name}_item"), F.col("_text").alias(f"_{name}_text"))

    (h, h_texts), (lo, lo_texts) = numbered(high, "high"), numbered(low, "low")
    drawn = h.join(lo, ["_key", "pos"])
    if cap_scope == "rubric" and cap is not None:
        drawn = drawn.orderBy("_key", "pos").limit(cap)
    h_texts, lo_texts = h_texts.withColumnRenamed("_high", "_h"), lo_texts.withColumnRenamed("_low", "_l")
    joined = drawn.join(h_texts, F.col("_high").eqNullSafe(F.col("_h"))).join(lo_texts, F.col("_low").eqNullSafe(F.col("_l")))
    joined = joined.select(
        "_key",
        "pos",
        common_source_item(F.col("_high_item"), F.col("_low_item"), fields).alias("source_item"),
        F.col("_high_text").alias("chosen"),
        F.col("_low_text").alias("rejected"),
    )
    topic = F.col("_key")
    if "korean_topic" in fields:
        topic = F.coalesce(F.col("source_item.korean_topic"), topic)
    return joined.select("*", one_row_each(rubrics).alias("rubric")).select(
        pair_id(kind.lower(), F.col("rubric"), topic, F.col("pos")).alias("pair_id"),
        "rubric",
        "source_item",
        "chosen",
        "rejected",
        F.lit(kind.upper()).alias("dataset_type"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def pairs_inter_model(
    high: DataFrame,
    low: DataFrame,
    rubrics: list[str] = V.RUBRICS,
    cap: int | None = None,
    order: list[str] = ["benchmark_id", "pos"],
    cap_scope: str = "key",
    created_at: str | None = None,
    item: str = "source_item",
    id: str | None = None,
    spread: bool = True,
) -> DataFrame:
    """Pair the i-th passage of a strong model with the i-th of a weak one.

    Both sides are numbered per benchmark item in the declared total order
    and joined on (item, number), which spreads an item with very many
    passages evenly. Only keys and order columns are numbered; texts join the
    pairs by ``id``, a column without repeats, or else by key and order. The
    pairs do not depend on the rubric, so they are made once and then repeated
    for every rubric. All passages are paired; ``cap`` bounds the pairs per item
    (or per rubric with ``cap_scope="rubric"``). ``spread=False`` numbers every
    item in one task.
    """
    return _positional(high, low, rubrics, order, cap, cap_scope, "IMP", created_at, item, id, spread)


def pairs_intra_model(
    high: DataFrame,
    low: DataFrame,
    rubric: str,
    order: list[str] = ["benchmark_id", "pos"],
    created_at: str | None = None,
    item: str = "source_item",
    id: str | None = None,
    spread: bool = True,
) -> DataFrame:
    """Pair good passages with passages that violate one rubric on purpose."""
    return _positional(high, low, [rubric], order, None, "key", "ICP", created_at, item, id, spread)


def rubric_of_template(template: Column) -> Column:
    """Rubric a violating template aims at; null for other templates."""
    out = None
    for name, rubric in V.VIOLATION_TEMPLATES.items():
        out = (F if out is None else out).when(template == name, rubric)
    return out


def pairs_by_template(
    chosen: DataFrame,
    rejected: DataFrame,
    model: str,
    version: str,
    templates: tuple[str, str] = (
        "passage_agent.create_passage",
        "passage_agent.create_passage_with_korean_errors",
    ),
    created_at: str | None = None,
    spread: bool = True,
) -> DataFrame:
    """Zip two templates' passages by list position inside a benchmark.

    Both sides carry benchmark_id, pos (from 0), source_item and
    generated_passage; ``chosen`` also problem_types and eval_goals. Pairs
    whose source items differ are dropped. Reply ids run over the whole
    result in benchmark and position order: places are numbered inside their
    benchmark, counts of benchmarks give the rest, and texts join last.
    """
    place = ["benchmark_id", "pos"]
    item = F.md5(F.to_json(F.struct("source_item")))  # 128 bits move instead of the items
    items = chosen.select(*place, item.alias("_c")).join(rejected.select(*place, item.alias("_r")), place)
    matched = items.where(F.col("_c") == F.col("_r")).select(*place)
    before = F.sum("_n").over(Window.orderBy("benchmark_id")) - F.col("_n")  # a row per benchmark
    sizes = matched.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("_n")).select("benchmark_id", before.alias("_before"))
    numbered = number_within(matched, ["benchmark_id"], [F.col("pos")], "_at", spread).join(sizes, "benchmark_id")
    ids = numbered.select(*place, (F.col("_before") + F.col("_at")).alias("reply_id"))
    c, r = chosen.alias("c"), rejected.select(*place, F.col("generated_passage").alias("_rejected")).alias("r")
    return ids.join(c, place).join(r, place).select(
        F.concat(F.lit("benchmark_"), "benchmark_id", F.lit(".item_"), "pos").alias("data_id"),
        F.array(F.lit("chosen"), F.lit("rejected")).alias("reply_type"),
        F.lit(model).alias("model_name"),
        source_prompt(F.col("c.source_item"), F.col("c.problem_types"), F.col("c.eval_goals")).alias("prompt"),
        F.col("c.generated_passage").alias("chosen"),
        F.col("_rejected").alias("rejected"),
        F.struct(
            F.col("benchmark_id").alias("benchmark_id"),
            F.lit(version).alias("benchmark_version"),
            F.col("c.source_item").alias("source_item"),
            F.col("c.problem_types").alias("problem_types"),
            F.col("c.eval_goals").alias("eval_goals"),
            F.lit(templates[0]).alias("chosen_template"),
            F.lit(templates[1]).alias("rejected_template"),
            F.lit(created_at).cast("timestamp").alias("created_at"),
        ).alias("metadata"),
        "reply_id",
    )


def scored(scores: DataFrame) -> DataFrame:
    """Rows that can be paired: with a score and a source."""
    if scores.schema["score"].dataType.typeName() not in ("byte", "short", "integer", "long", "decimal"):
        raise TypeError("scores are whole numbers or decimals: gaps of floats are not exact")
    return scores.where(F.col("score").isNotNull() & F.col("source_key").isNotNull())


def score_groups(scores: DataFrame) -> DataFrame:
    """Passages per rubric, source key and score; rows without score are out."""
    return scored(scores).groupBy("rubric", "source_key", "score").agg(F.count(F.lit(1)).alias("n"))


def score_levels(scores: DataFrame, min_gap: float = 1) -> DataFrame:
    """Score levels of a rubric and source in order, with sums over those before and behind.

    ``n`` passages have the ``score`` of a level, ``before`` a smaller one,
    ``below`` one smaller by ``min_gap`` or more, ``above`` one larger by that,
    and ``n_all`` any. Sums run over levels, never over passages or pairs.
    """
    if min_gap <= 0:
        raise ValueError("min_gap must be positive: chosen has to score higher")
    own = "OVER (PARTITION BY rubric, source_key ORDER BY score"
    spans = {
        "before": f"sum(n) {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "below": f"sum(n) {own} RANGE BETWEEN UNBOUNDED PRECEDING AND {min_gap} PRECEDING)",
        "above": f"sum(n) {own} RANGE BETWEEN {min_gap} FOLLOWING AND UNBOUNDED FOLLOWING)",
        "n_all": "sum(n) OVER (PARTITION BY rubric, source_key)",
    }
    return score_groups(scores).select("*", *[F.coalesce(F.expr(s), F.lit(0)).alias(c) for c, s in spans.items()])


def score_gap_totals(scores: DataFrame, min_gap: float = 1) -> DataFrame:
    """Pairs per rubric, source key and high score: one row per level, from the sums before it."""
    levels = score_levels(scores, min_gap).where("below > 0")
    return levels.select("rubric", "source_key", F.col("score").alias("high_score"), (F.col("n") * F.col("below")).alias("n_pairs"))


def score_gap_counts(scores: DataFrame, min_gap: float = 1) -> DataFrame:
    """How many pairs :func:`pairs_by_score_gap` makes, without making them: a row per high and low score.

    The number of pairs of two score levels is the product of their sizes, so
    counts need one row per pair of levels instead of one per pair.
    """
    if min_gap <= 0:
        raise ValueError("min_gap must be positive: chosen has to score higher")
    keys = ["rubric", "source_key"]
    levels = score_groups(scores)
    high = levels.select(*keys, F.col("score").alias("high_score"), F.col("n").alias("_high"))
    low = levels.select(*keys, F.col("score").alias("low_score"), F.col("n").alias("_low"))
    margin = F.col("high_score") - F.col("low_score")
    return high.join(low, keys).where(margin >= min_gap).select(
        *keys, "high_score", "low_score", margin.alias("margin"), (F.col("_high") * F.col("_low")).alias("n_pairs")
    )


def pairs_by_score_gap(
    scores: DataFrame,
    min_gap: float = 1,
    carry: list[str] = [],
    cell_rows: int = CELL_ROWS,
    together: bool = False,
) -> DataFrame:
    """Every (higher, lower) passage pair of one rubric and source key.

    ``scores`` holds passage_id, rubric, source_key and score. ``chosen_id``
    always has the higher score; columns named in ``carry`` come along as
    ``chosen_…`` and ``rejected_…``. The result itself grows with the square
    of a source's passages: ask :func:`score_gap_counts` first, or draw some by
    ``sample_score_gap_pairs``.

    The join makes result rows only. A chosen passage meets each lower level of
    the table of levels, of which there may be any number, a rejected one its
    own, and the join key is the level, so no pair is built and thrown away.
    Large levels are cut into cells: chosen passages fall into rows of a grid,
    rejected ones into columns, each is copied along its row or column, and a
    task meets at most ``cell_rows`` of either side at a time. Groups below that
    size have one cell and no copies. Cells are dealt out evenly by number: ids
    are few bytes for the pairs they make, so by size Spark would put most cells
    together in a few tasks.

    ``together`` gives the same pairs, a row for each chosen passage and cell with
    its rejected ids in a list ``rejected_ids`` (:func:`one_by_one` undoes it); nothing
    can be carried then. A cell's ids are copied as lists.
    """
    if together and carry:
        raise ValueError("lists of rejected ids carry no columns")
    keys, cell = ["rubric", "source_key"], ["low_score", "_row", "_column"]
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = score_levels(scores, min_gap).select(*keys, F.col("score").alias("low_score"), "n", "n_all", "above")
    lower = levels.where("above > 0")
    rows = scored(scores).select(*keys, "passage_id", "score", *carry)
    spot = F.xxhash64("passage_id")

    def cells(n: str) -> Column:
        return F.ceil(F.col(n) / cell_rows).cast("int")

    def copied(n: str, to: str) -> Column:
        return F.explode(F.sequence(F.lit(0), cells(n) - 1)).alias(to)

    chosen = (
        rows.join(lower, keys)
        .where(F.col("score") - F.col("low_score") >= min_gap)
        .withColumn("_row", F.pmod(spot, cells("n_all")).cast("int"))
        .select(
            *keys,
            "low_score",
            "_row",
            "n",
            F.col("passage_id").alias("chosen_id"),
            F.col("score").alias("high_score"),
            *[F.col(c).alias(f"chosen_{c}") for c in carry],
        )
    )
    rejected = rows.withColumnRenamed("score", "low_score").join(lower, [*keys, "low_score"]).select(
        *keys,
        "low_score",
        F.pmod(spot, cells("n")).cast("int").alias("_column"),
        "n_all",
        F.col("passage_id").alias("rejected_id"),
        *[F.col(c).alias(f"rejected_{c}") for c in carry],
    )
    if together:
        # structs, as a list of ids alone would leave out nulls
        held = F.collect_list(F.struct("chosen_id", "high_score")).alias("_held")
        chosen = chosen.groupBy(*keys, "low_score", "_row", "n").agg(held)
        ids = F.collect_list(F.struct("rejected_id"))["rejected_id"].alias("rejected_ids")
        rejected = rejected.groupBy(*keys, "low_score", "_column", "n_all").agg(ids)
    chosen = chosen.select("*", copied("n", "_column")).drop("n").repartition(parts, *keys, *cell)
    rejected = rejected.select("*", copied("n_all", "_row")).drop("n_all").repartition(parts, *keys, *cell)
    if together:
        chosen = chosen.select(*keys, *cell, F.inline("_held"))
        rejected = rejected.hint("merge")  # pairs then come in the order of their rubric, which writers ask for
    return (
        chosen.join(rejected, [*keys, *cell])
        .drop("_row", "_column")
        .withColumn("margin", F.col("high_score") - F.col("low_score"))
    )


def one_by_one(pairs: DataFrame) -> DataFrame:
    """A row per pair, of pairs that share rows in lists ``rejected_ids``, of which none is empty."""
    each = F.explode_outer("rejected_ids")  # asks no list for its length first
    return pairs.select(*[c for c in pairs.columns if c != "rejected_ids"], each.alias("rejected_id"))


def pairs_by_label(samples: DataFrame, order: list[str] = ["pos"]) -> DataFrame:
    """Pair each high quality sample with the first low one of its topic.

    Samples whose name carries no known label are ignored. ``order`` tells the
    samples of a topic apart: the first low one is found by it alone, then its
    text joins, so many high rows of a topic meet one row. They share their
    pair id and differ in ``metadata.chosen_name``.
    """
    high, low = _labelled(samples, "high", V.HIGH_PREFIX), _labelled(samples, "low", V.LOW_PREFIX)
    places = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    first = low.select("topic", *places).groupBy("topic").agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))])).alias("_o"))
    texts = low.select(F.col("topic").alias("_t"), F.struct(*places).alias("_p"), F.struct("text", "name").alias("low"))
    first = first.join(texts, (F.col("topic") == F.col("_t")) & F.col("_o").eqNullSafe(F.col("_p"))).select("topic", "low")
    return high.join(first, "topic").select(
        F.concat(F.lit("preference_pair_"), "topic").alias("pair_id"),
        "topic",
        F.col("text").alias("chosen"),
        F.col("low.text").alias("rejected"),
        F.lit("high").alias("chosen_quality"),
        F.lit("low").alias("rejected_quality"),
        F.struct(F.col("name").alias("chosen_name"), F.col("low.name").alias("rejected_name")).alias("metadata"),
    )


def unmatched_by_label(samples: DataFrame) -> DataFrame:
    """High quality samples whose topic has no low quality one."""
    high, low = _labelled(samples, "high", V.HIGH_PREFIX), _labelled(samples, "low", V.LOW_PREFIX)
    return high.join(low.select("topic").distinct(), "topic", "left_anti").select("name", "topic")


def _labelled(samples: DataFrame, quality: str, prefix: str) -> DataFrame:
    return samples.where(
        (F.col("quality") == quality) & F.startswith(F.col("name"), F.lit(prefix))
    ).withColumn("topic", topic_from_name("name"))


def verdicts(evals: DataFrame, mode: str = "per_rubric", rubrics: list[str] = V.RUBRICS) -> DataFrame:
    """(passage_id, rubric, passed) a filter based data set is drawn from.

    ``per_rubric`` keeps pass and fail results of each rubric. ``all_six``
    calls a passage passed if all rubrics passed, failed if any was judged
    and did not pass, and offers that verdict to every rubric.
    """
    decided = evals.where(F.col("result").isin("pass", "fail"))
    if mode == "per_rubric":
        return decided.select("passage_id", "rubric", (F.col("result") == "pass").alias("passed"))
    if mode != "all_six":
        raise ValueError("mode is per_rubric or all_six")
    whole = evals.groupBy("passage_id").agg(
        F.count_if(F.col("result") == "pass").alias("n_pass"),
        F.count_if(F.col("result").isin("fail", "uncertain")).alias("n_fail"),
    )
    passed = F.when(F.col("n_pass") == len(rubrics), True).when(F.col("n_fail") > 0, False)
    return (
        whole.select("passage_id", passed.alias("passed"))
        .where(F.col("passed").isNotNull())
        .select("passage_id", one_row_each(rubrics).alias("rubric"), "passed")
    )


def _whole_item(passages: DataFrame) -> Column:
    """The source item with problem types and goals, from beside it where it has none."""
    names = passages.schema["source_item"].dataType.names
    more = ["problem_types", "eval_goals"]
    held = {n: F.col("source_item")[n] for n in names}
    for n in more:
        if n in passages.columns:
            held[n] = F.coalesce(held[n], F.col(n)) if n in held else F.col(n)
    return F.when(F.col("source_item").isNotNull(), F.struct(*[c.alias(n) for n, c in held.items()]))


def pairs_by_filter(
    evals: DataFrame,
    passages: DataFrame,
    target: int | None = None,
    seed: int = 42,
    mode: str = "per_rubric",
    same_source: bool = False,
    created_at: str | None = None,
) -> DataFrame:
    """Sample passed and failed passages without replacement and zip them.

    ``evals`` has passage_id, rubric and result; ``passages`` passage_id,
    source_item and a text column. All passages are paired, or up to
    ``target`` pairs per rubric (per rubric and source key with
    ``same_source``), drawn in a seeded hash order, whose digests deal a group
    out over all tasks. Only ids are ordered; texts join the drawn pairs afterwards. Problem types and goals that lie beside
    the source item are put into it where it has none.
    """
    drawn = verdicts(evals, mode)
    groups = ["rubric"]
    if same_source:
        key = group_key(passages).alias("_source")
        drawn = drawn.join(passages.select("passage_id", key), "passage_id").where(F.col("_source").isNotNull())
        groups = ["rubric", "_source"]
    lot = shuffled(seed, F.col("rubric"), F.col("passage_id"))
    numbered = draw_within(drawn.withColumn("_lot", lot), [*groups, "passed"], "_lot", [F.col("passage_id")], target, "n")
    good = numbered.where("passed").select(*groups, "n", F.col("passage_id").alias("good_id"))
    bad = numbered.where("not passed").select(*groups, "n", F.col("passage_id").alias("bad_id"))
    text = passage_text(passages)
    item = _whole_item(passages).alias("source_item")
    chosen = passages.select(F.col("passage_id").alias("good_id"), item, text.alias("chosen"))
    rejected = passages.select(F.col("passage_id").alias("bad_id"), text.alias("rejected"))
    topic = F.coalesce(F.col("source_item.korean_topic"), F.lit("unknown"))
    return (
        good.join(bad, [*groups, "n"])
        .join(chosen, "good_id")
        .join(rejected, "bad_id")
        .select(
            pair_id("spf", F.col("rubric"), topic, F.col("n")).alias("pair_id"),
            "rubric",
            "source_item",
            "chosen",
            "rejected",
            F.lit("SPF").alias("dataset_type"),
            F.lit(created_at).cast("timestamp").alias("created_at"),
        )
    )


def with_guideline(df: DataFrame, guidelines: DataFrame, item: str = "source_item") -> DataFrame:
    """Put a benchmark's problem types and goals into the source item.

    A plain join: Spark broadcasts the guidelines while they are small by its
    own measure and falls back to a shuffle when they are not.
    """
    g = guidelines.select("benchmark_id", "problem_types", "eval_goals")
    names = [n for n in df.schema[item].dataType.names if n not in ("problem_types", "eval_goals")]
    filled = F.struct(*[F.col(item)[n].alias(n) for n in names], "problem_types", "eval_goals")
    return df.join(g, "benchmark_id").withColumn(item, filled).drop("problem_types", "eval_goals")


def stem_tasks(passages: DataFrame) -> DataFrame:
    """One row per passage and (problem type, goal), numbered from 1."""
    zipped = F.arrays_zip("problem_types", "eval_goals")
    keep = [c for c in passages.columns if c not in ("problem_types", "eval_goals")]
    return passages.select(*keep, F.posexplode(zipped).alias("_at", "_task")).select(
        *keep,
        (F.col("_at") + 1).alias("j"),
        F.col("_task.problem_types").alias("problem_type"),
        F.col("_task.eval_goals").alias("eval_goal"),
    )


def stems_wide(stems: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Back to one row per passage; a missing stem gets the failure text."""
    out = []
    for j in range(1, n + 1):
        here = F.col("j") == j
        text = F.coalesce(F.nullif(F.col("stem"), F.lit("")), F.lit(V.STEM_FAILED))
        out += [
            F.max(F.when(here, F.col("problem_type"))).alias(f"problem_type_{j}"),
            F.max(F.when(here, F.col("eval_goal"))).alias(f"eval_goal_{j}"),
            F.max(F.when(here, text)).alias(f"stem_{j}"),
        ]
    return stems.groupBy(*keys).agg(*out)


def generation_grid(items: DataFrame, models: list[str], templates: list[str]) -> DataFrame:
    """Every item with every model and template, by two explodes."""
    return items.select("*", one_row_each(models).alias("model")).select("*", one_row_each(templates).alias("template"))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides, once each."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").where(F.col(key).isNotNull())


def attach_text(results: DataFrame, pairs: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` results in ``order`` with the texts of their pairs.

    At most ``k`` rows are broadcast, so the pair table is read once and
    never shuffled.
    """
    top = results.orderBy(*order).limit(k)
    return pairs.join(F.broadcast(top), "pair_id")
