"""The engine's named queries over the driver's tables, and the SQL that gives the same rows.

Ratios are rounded to nine digits on both sides; timestamps are given as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..functions import languages
from ..functions import text as T
from ..operators import corpora, distinct, evaluation, gold, merge, sampling, stored, tagging, trees
from ..operators.durable import durable, shared_dir
from ..schemas import RAW_COLUMNS
from ..sources import collect
from ..sources.archive import archive_path
from ..streaming import enrichment, event_time
from . import checks, views


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        c = F.round(c, 9) if kind == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp" else F.date_format(c, "yyyy-MM-dd") if kind == "date" else c
        out.append(c.alias(name))
    return df.select(*out)


def _view(name: str):
    return lambda spark, d: tidy(views.VIEWS[name](bridge.events(spark, d)))


FINGERPRINT = ["id", "source", "language", "score", "event_tag", "sentiment_label"]


def _mark():
    """For a column of records: told where the documents are read, so their texts stay there."""
    return distinct.text_mark(F.col("text"))


def _staging(spark, d):
    return merge.latest(bridge.landing(spark, d).drop("doc_id"), "collected_at")


def _target(spark, d):
    return bridge.records(spark, d).where("doc_id % 2 = 0").select(*RAW_COLUMNS)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Every record as a message; every eleventh is spoilt."""
    rows = bridge.records(spark, d)
    good = tagging.messages(rows.where("doc_id % 11 <> 0"), "2024-03-01T00:00:00Z")
    bad = rows.where("doc_id % 11 = 0").select(F.encode(F.concat(F.lit("{'id': "), "id"), "UTF-8").alias("data"), F.create_map(F.lit("source"), "source").alias("attributes"))
    return good.unionByName(bad)


def _texts(spark, d):
    return bridge.records(spark, d)


def _lang_rank(spark, d):
    return bridge.events(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "language").limit(15)


def _baseline(spark, d):
    outside = spark.createDataFrame([("2024-01-12", 92), ("2024-01-13", 91), ("2024-01-20", 90)], "date_utc string, metascore int")
    daily = views.dashboard_rollup(views.v_sentiment_daily(bridge.events(spark, d)).withColumn("date_utc", F.date_format("event_date", "yyyy-MM-dd")), "date_utc")
    return daily.join(F.broadcast(outside), "date_utc").select("date_utc", "metascore", "records", "net_sentiment")


def _review(spark, d):
    """Review rows: the model's label from the stub, a person's where the document is labelled; every fourth one required."""
    human = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(F.lit("pos"), F.lit(" NEU "), F.lit("neg")), (F.col("doc_id") % 7 % 3 + 1).cast("int"))).otherwise("")
    rows = bridge.events(spark, d).where("doc_id % 2 = 1")
    return rows.select("id", "language", human.alias("label"), F.col("sentiment_label").alias("label_llm"), F.when(F.col("doc_id") % 4 == 1, "Yes").otherwise("no").alias("review_required"), F.col("doc_id").alias("position"))


def _old_gold(spark, d):
    rows = bridge.gold(spark, d).where("doc_id % 2 = 0 OR doc_id % 10 = 5")
    return rows.select("id", "language", F.upper("gold").alias("label"), "split")


def _pool(spark, d):
    return bridge.events(spark, d).select("id", "text", F.col("sentiment_label").alias("label"), F.lit("pool").alias("source"))


def _gold_texts(spark, d):
    return bridge.gold(spark, d, "text").select("id", "text", F.col("gold").alias("label"), "source", "split")


def _kinds(spark, d):
    rows, n = bridge.records(spark, d), F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    return rows.select("id", T.corpus_label("sst2", n % 2).alias("sst2"), T.corpus_label("tweet_eval", n % 3).alias("tweet_eval"), T.corpus_label("sentiment140", n % 3 * 2).alias("sentiment140"), T.corpus_label("clapai", pick("Positive", "neutral ", "NEGATIVE")).alias("clapai"))


def _predictions(spark, d):
    """Two predictions for every third row; the later one counts."""
    rows = bridge.gold(spark, d).where("doc_id % 4 <> 0").select("id", "doc_id", "pred", F.lit(1).alias("pos"))
    return rows.unionByName(rows.where("doc_id % 3 = 0").withColumns({"pred": F.lit("neu"), "pos": F.lit(2)})).drop("doc_id")


def _fake():
    return lambda texts: [[float(len(t) % 5), 1.0, 2.0] for t in texts]


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Turns as flat replies, each to the turn at half its number; every ninth conversation has lost its first turn."""
    at = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    turns = bridge.table(spark, d, "conversations").where("conv_id % 9 <> 4 OR turn > 0")
    return turns.select(at(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, at(F.expr("(turn - 1) div 2"))).alias("parent_id"), "conv_id", "turn", "text")


def _comment_trees(spark: SparkSession, d: str) -> DataFrame:
    rows = _replies(spark, d)
    return trees.reply_depths(rows.where("parent_id IS NULL"), rows.where("parent_id IS NOT NULL")).select("id", "parent_id", "root", "depth")


def _search_records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as posts, an hour apart, found in a window that leaves the first two out; their turns as comments."""
    said = F.concat(F.lit("w"), F.col("turn").cast("string"))
    made = (F.lit(1704067200.0) + F.col("conv_id") * 3600 + F.col("turn") * 60 + 0.5).alias("created_utc")
    rows = _replies(spark, d)
    one = [F.col("id").alias("fullname"), F.when(F.col("turn") % 4 > 0, said).alias("author"), F.col("conv_id").alias("score"), made]
    posts = rows.where("turn = 0").select(*one, F.lit(" A title").alias("title"), F.col("text").alias("selftext"), F.expr("'r' || conv_id % 5").alias("subreddit"))
    comments = rows.where("turn > 0").select(*one, F.col("text").alias("body"), "parent_id")
    found = collect.reddit_search(posts, comments, "launch", bridge.SALT, F.lit(bridge.COLLECTED).cast("timestamp"), since="2024-01-01 02:00:00")
    return tidy(found.select("id", "parent_id", "created_utc", "author_hash", F.md5("text").alias("digest"), "score", "context_id", "event_tag"))


def _profile_enrich(spark: SparkSession, d: str) -> DataFrame:
    """The stream's enrichment with a detector of profiles in place of the word lists; how often it names the declared language."""
    docs = bridge.table(spark, d, "documents").select(F.col("lang").alias("language"), "text")
    detect = languages.detector(languages.fit(docs, min_rows=2))
    rows = enrichment.enrich(enrichment.parse(_messages(spark, d)), bridge.PROCESSED, detect=detect).select("id", "language")
    told = rows.join(bridge.records(spark, d).select("id", F.col("language").alias("declared")), "id")
    return told.groupBy("declared").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("language") == F.col("declared")) * 100 >= F.count(F.lit(1)) * 98).alias("right"))


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids and texts run into each other in chains: some 400 ids in 2000 documents, 500 texts in 3000."""
    docs = bridge.table(spark, d, "documents")
    named = lambda lead, block, number: F.concat(F.lit(lead), F.expr(f"doc_id div {block}").cast("string"), F.lit(":"), number.cast("string"))
    return docs.select("doc_id", named(" k", 2000, F.col("doc_id") * 7919 % 1009 % 400).alias("id"), F.concat(named("t", 3000, F.col("doc_id") * 104729 % 997 % 500), F.lit("\n")).alias("text"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Per language, whether profiles of the even ids name at least 98 of 100 texts of odd ids."""
    docs = bridge.table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), "text")
    detect = languages.detector(languages.fit(docs.where("doc_id % 2 = 0"), min_rows=2))
    found = docs.where("doc_id % 2 = 1").withColumn("found", detect(F.col("text")))
    return found.groupBy("language").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("found") == F.col("language")) * 100 >= F.count(F.lit(1)) * 98).alias("right"))


def _stored_merge(spark: SparkSession, d: str) -> DataFrame:
    """All record columns but the text, which the records' own joins would shuffle several times."""
    target = _target(spark, d).drop("text")
    table = stored.StoredTable.create(target, f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", parts=16).merge(target, "collected_at")
    return table.merge(bridge.landing(spark, d).select(*target.columns), "collected_at").read()


def _view_assertions(spark: SparkSession, d: str) -> DataFrame:
    events = durable(bridge.events(spark, d).drop("text"))  # written once, all views read that
    return checks.view_assertions({name: view(events) for name, view in views.VIEWS.items()})


def _mark_review(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("p_pos") < 0.2, "Low ").otherwise("high")
    rows = bridge.gold(spark, d).where("doc_id % 2 = 1").select("id", "language", F.col("pred").alias("label_llm"), word.alias("llm_confidence"))
    held = bridge.gold(spark, d).where("doc_id % 20 = 0")
    return gold.mark_review(rows, held, holdout_target=60, dev_n=20).select("id", "label_llm", "review_required")


def _timed_messages(spark: SparkSession, d: str) -> DataFrame:
    return event_time.labelled(_messages(spark, d).withColumn("arrived", F.lit(bridge.COLLECTED).cast("timestamp")))


QUERIES = {name: _view(name) for name in views.VIEWS} | {
    "time_windows": lambda s, d: tidy(views.time_windows(bridge.events(s, d), bridge.LAUNCH)),
    "event_polarity": lambda s, d: tidy(views.event_polarity(bridge.events(s, d))),
    "dashboard_rollup": lambda s, d: tidy(views.dashboard_rollup(views.v_sentiment_daily(bridge.events(s, d)), "source")),
    "top_languages": _lang_rank,
    "external_baseline_join": lambda s, d: tidy(_baseline(s, d)),
    "records_reconcile": lambda s, d: checks.records_reconcile(bridge.events(s, d)),
    "check_unique_key": lambda s, d: checks.unique_key(bridge.landing(s, d), "id"),
    "check_row_conditions": lambda s, d: checks.row_conditions(views.v_event_lift(bridge.events(s, d)), "net_lift BETWEEN -2 AND 2", "records < 50").select("event_tag", "source", "records", "broken"),
    "collection_quality": lambda s, d: tidy(checks.collection_quality(bridge.landing(s, d))),
    "staging_dedup_latest": lambda s, d: tidy(_staging(s, d).select("id", "collected_at", "score")),
    "events_promote_merge": lambda s, d: tidy(merge.merge_latest(_target(s, d), bridge.landing(s, d).select(*RAW_COLUMNS), "collected_at").select("id", "score", "collected_at", "merge_action")),
    "coverage": lambda s, d: merge.coverage(bridge.records(s, d), bridge.landing(s, d).where("doc_id % 13 <> 0")),
    "fingerprint_md5": lambda s, d: merge.fingerprint_md5(bridge.events(s, d), FINGERPRINT),
    "replay_query": lambda s, d: tidy(tagging.replay(bridge.records(s, d), "launch", "2024-01-11", "2024-01-14").select("id", "created_utc", "event_tag", "voted_up")),
    "replay_schedule": lambda s, d: tidy(tagging.schedule(bridge.records(s, d))),
    "build_message_attrs": lambda s, d: tagging.messages(bridge.records(s, d), "2024-03-01T00:00:00Z").select(
        F.expr("get_json_object(CAST(data AS STRING), '$.id')").alias("id"), *[F.col("attributes")[k].alias(k) for k in ("source", "event_tag", "created_utc", "replayed_at")]
    ),
    "nearest_event_tag": lambda s, d: bridge.records(s, d).select("id", "event_tag"),
    "window_filter": lambda s, d: tagging.window_filter(bridge.records(s, d), "2024-01-10", "2024-01-20").select("id"),
    "author_hash": lambda s, d: bridge.records(s, d).select("id", "author_hash"),
    "archive_path": lambda s, d: bridge.records(s, d).select("id", archive_path(F.col("source"), F.col("event_tag"), F.col("created_utc"), F.md5("id")).alias("path")),
    "stub_sentiment": lambda s, d: bridge.events(s, d).select("id", "sentiment_label", "sentiment_score"),
    "normalize_text": lambda s, d: _texts(s, d).select("id", F.md5(T.normalise(F.concat(F.col("text"), F.lit(" @Alice\t\thttps://x.org/a?b  me@site.com WWW.y.com ")))).alias("digest")),
    "token_estimate": lambda s, d: tidy(_texts(s, d).select("id", T.token_estimate(F.col("text")).alias("tokens"))),
    "label_alias_map": lambda s, d: _texts(s, d).select("id", T.label_alias(F.element_at(F.array(*map(F.lit, (" LABEL_0 ", "Neutral", "POSITIVE", "neg"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("label")),
    "goemotions_collapse": lambda s, d: _texts(s, d).select("id", T.emotion_class(F.array(
        F.element_at(F.array(F.lit("Joy"), F.lit("surprise"), F.lit("LOVE")), (F.col("doc_id") % 3 + 1).cast("int")),
        F.element_at(F.array(F.lit("Anger"), F.lit("curiosity")), (F.col("doc_id") % 2 + 1).cast("int")))).alias("label")),
    "validate_dead_letter": lambda s, d: enrichment.parse(_messages(s, d)).groupBy(F.coalesce("error", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
    "gold_sample_sql": lambda s, d: sampling.gold_sample(bridge.records(s, d)).select("id", "source", "language"),
    "prelabel_candidates": lambda s, d: sampling.prelabel_candidates(bridge.landing(s, d, mark=_mark()), bridge.records(s, d).where("doc_id % 5 = 0"), "doc_id", "mark").select("id"),
    "chunk_packs": lambda s, d: sampling.chunk_packs(bridge.records(s, d).where("doc_id % 3 <> 1").select("id", "doc_id"), 200, "doc_id").groupBy("chunk").agg(F.count(F.lit(1)).alias("n")),
    "label_counts": lambda s, d: bridge.events(s, d).groupBy(F.concat_ws("=", "sentiment_label", "source").alias("key")).agg(F.count(F.lit(1)).alias("n")),
    "confusion_matrix": lambda s, d: evaluation.confusion(bridge.gold(s, d)),
    "classification_metrics": lambda s, d: tidy(evaluation.metrics(bridge.gold(s, d))),
    "metrics_by_slice": lambda s, d: tidy(evaluation.metrics_by_slice(bridge.gold(s, d)).select("slice_kind", "slice", "n", "accuracy", "macro_f1")),
    "cohen_kappa": lambda s, d: tidy(evaluation.cohen_kappa(bridge.gold(s, d), "gold", "pred")),
    "class_weights": lambda s, d: tidy(evaluation.class_weights(bridge.gold(s, d), "gold")),
    "threshold_sweep": lambda s, d: tidy(evaluation.threshold_sweep(bridge.gold(s, d)).select("threshold", "n", "accuracy", "f1_neg", "macro_f1")),
    "review_flags": lambda s, d: sampling.review_flags(bridge.gold(s, d).select("id", F.col("pred").alias("label_llm"), F.col("p_pos").alias("llm_confidence"))).select("id", "review_required"),
    "oversample": lambda s, d: sampling.oversample(bridge.gold(s, d).select("id"), 3),
    "detect_language": lambda s, d: _texts(s, d).select("id", T.detect_language(F.col("text")).alias("language")),
    "stream_enrich": lambda s, d: enrichment.enrich(enrichment.parse(_messages(s, d)), bridge.PROCESSED).drop("text"),
    "stratified_split": lambda s, d: sampling.train_eval_split(bridge.gold(s, d), 0.2, "gold").select("id", "gold", "part"),
    "reservoir_sample": lambda s, d: sampling.reservoir(bridge.records(s, d), 10, ["language", "source"]).select("id", "language", "source"),
    "view_assertions": _view_assertions,
    "period_report": lambda s, d: tidy(views.period_report(bridge.events(s, d), "week")),
    "tokens": lambda s, d: _texts(s, d).select("id", F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("digest")),
    "fit_to_tokens": lambda s, d: _texts(s, d).select("id", F.length(T.fit_to_tokens(T.normalise(F.col("text")))).alias("kept")),
    "corpus_label_maps": _kinds,
    "score_vectors": lambda s, d: tidy(bridge.gold(s, d).select("id", T.from_scores(F.array("p_neg", "p_neu", "p_pos")).alias("s")).select("id", "s.label", "s.score")),
    "gold_pred_join": lambda s, d: bridge.gold(s, d).select("id", "gold").join(evaluation.last_predictions(_predictions(s, d)).select("id", "pred"), "id"),
    "remote_classifier_fake": lambda s, d: tidy(_texts(s, d).select("id", enrichment.pandas_classifier(_fake)(F.col("text")).alias("s")).select("id", "s.label", "s.score")),
    "best_threshold": lambda s, d: tidy(evaluation.best_threshold(evaluation.threshold_sweep(bridge.gold(s, d)))),
    "gold_merge": lambda s, d: gold.merge_gold(_old_gold(s, d), _review(s, d), holdout_target=120, dev_n=20),
    "split_allocation": lambda s, d: gold.allocate_splits(bridge.gold(s, d).select("id", "language", F.col("gold").alias("label")), 60, 30),
    "prelabel_agreement": lambda s, d: tidy(gold.prelabel_agreement(gold.resolved(_old_gold(s, d), _review(s, d))).crossJoin(gold.dropped_unreviewed(_old_gold(s, d), _review(s, d)))),
    "corpus_mix": lambda s, d: corpora.corpus_mix({"pool": _pool(s, d)}, {"pool": 90}, _gold_texts(s, d), 2).select("id", "label", "source"),
    "stage2_rows": lambda s, d: corpora.stage2_rows(_gold_texts(s, d), _pool(s, d), 3, 60).select("id", "label", "source"),
    "balanced_sample": lambda s, d: corpora.balanced_sample(bridge.events(s, d).withColumnRenamed("sentiment_label", "label"), 12).select("id", "language", "label"),
    "proportional": lambda s, d: sampling.proportional(bridge.gold(s, d), 100, "gold").select("id", "gold"),
    "stratified_sample": lambda s, d: sampling.stratified(bridge.records(s, d), 50, ["source", "language"]).select("id", "source", "language"),
    "time_slices": lambda s, d: tidy(collect.search_requests(bridge.records(s, d))),
    "video_ids": lambda s, d: collect.video_ids(bridge.records(s, d).select(F.concat(F.when(F.col("doc_id") % 5 == 0, "REPLACE_").otherwise("v"), "id").alias("id"), F.array("event_tag", F.lit("reveal")).alias("event_ids")), "launch"),
    "search_records": _search_records,
    "profile_enrich": _profile_enrich,
    "mark_review": _mark_review,
    "prelabel_rows": lambda s, d: tidy(sampling.prelabel_rows(sampling.prelabel_candidates(bridge.records(s, d, mark=_mark()), bridge.records(s, d).where("doc_id % 5 = 0"), "doc_id", "mark")).drop("text")),
    "comment_trees": _comment_trees,
    "first_by_id_or_text": lambda s, d: distinct.first_by_id_or_text(_conflicts(s, d), "doc_id")[0].select("doc_id"),
    "language_profiles": _profiles,
    "stored_merge": lambda s, d: tidy(_stored_merge(s, d).select("id", "score", "collected_at")),
    "event_time_windows": lambda s, d: tidy(event_time.window_counts(_timed_messages(s, d))),
    "completeness_gate": lambda s, d: enrichment.gate(bridge.records(s, d), bridge.events(s, d).where("doc_id % 13 <> 0"), bridge.PROCESSED),
}
