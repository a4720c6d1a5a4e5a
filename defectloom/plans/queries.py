"""The registered queries: every operator over the given tables."""

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.functions import text as X
from defectloom.operators import augment as G
from defectloom.operators import filters, history, leaderboard, lexed, metrics, model, mutations, pairs
from defectloom.operators import profile, splits, tokens, validate, variants
from defectloom.plans import bindings as B
from defectloom.plans import dataset, training
from defectloom.schema import SPLITS
from defectloom.sources import bug_tree, code_dirs, reports, samples, test_cases, verify_log
from defectloom.streaming import batches as stream_rule, scoring
from defectloom.workspace import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SAMPLE_COLUMNS = ("id", "source", "project", "path", "func_name", "code", "is_buggy", "pair_id")
BATCH = 8
PREVIEW_BATCH = 100
METRIC_COLUMNS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "avg_confidence")
SEED = 42
FILES_PER_TRIGGER = 64
STREAM_FILES = 6
SETTINGS = training.TrainSettings()
COUNTS = replace(SETTINGS, classifier="counts")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def split_samples(spark, sf) -> DataFrame:
    return splits.sorted_split(B.samples(spark, sf), main_source=B.MAIN_SOURCE)


def preds(spark, sf) -> DataFrame:
    facts = B.samples(spark, sf).select("id", "source", "project", "is_buggy")
    return metrics.attach_predictions(facts, B.predictions(spark, sf))


def split_preds(spark, sf) -> DataFrame:
    return splits.sorted_split(
        preds(spark, sf), main_source=B.MAIN_SOURCE, members=B.samples(spark, sf)
    )


def written_splits(spark, sf) -> DataFrame:
    """The split table as a job leaves it for the next one."""
    path = f"{work_dir(spark)}/splits"
    samples.save_splits(split_samples(spark, sf), path)
    return spark.read.parquet(path)


# Scans and sinks


@query
def load_samples(spark, sf):
    path = f"{work_dir(spark)}/samples"
    samples.save_samples(B.samples(spark, sf), path)
    found = samples.load_samples(spark, path)
    return found.unionByName(samples.load_samples(spark, f"{path}-missing"))


@query
def roundtrip_parquet(spark, sf):
    path = f"{work_dir(spark)}/corpus"
    samples.save_samples(B.corpus(spark, sf), path)
    return spark.read.parquet(path).select("id", "project", F.md5("code").alias("code_md5"))


@query
def split_sink_roundtrip(spark, sf):
    path = f"{work_dir(spark)}/splits"
    samples.save_splits(split_samples(spark, sf), path)
    parts = [
        samples.load_split(spark, path, name).select(F.lit(name).alias("split"), "id", "project")
        for name in SPLITS
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def scan_code_dirs(spark, sf):
    root = work_dir(spark)
    B.write_code_dirs(spark, sf, root)
    return code_dirs.code_dir_samples(spark, root, "programs")


@query
def scan_bug_tree(spark, sf):
    root = work_dir(spark)
    B.write_bug_tree(spark, sf, root)
    return bug_tree.bug_tree_samples(bug_tree.scan_bug_tree(spark, root), "tree")


@query
def stats_json(spark, sf):
    return reports.stats_json(rounded(split_stats(spark, sf), "avg_length"))


@query
def stats_from_json(spark, sf):
    path = f"{work_dir(spark)}/stats"
    reports.save_text(reports.stats_json(profile.split_statistics(split_samples(spark, sf))), path)
    return rounded(reports.load_stats(spark, path), "avg_length")


@query
def stats_report_lines(spark, sf):
    return reports.stats_report(profile.split_statistics(split_samples(spark, sf)))


@query
def stats_detail_lines(spark, sf):
    return reports.detail_report(profile.wide_statistics(split_samples(spark, sf)))


@query
def stats_band_lines(spark, sf):
    return reports.band_report(profile.wide_statistics(split_samples(spark, sf)))


@query
def testcases_normalised(spark, sf):
    return test_cases.normalise_test_cases(B.test_case_lines(spark, sf))


@query
def verified_ids(spark, sf):
    return verify_log.verified_ids(B.log_lines(spark, sf))


@query
def model_card(spark, sf):
    found = metrics.summary_metrics(metrics.confusion(preds(spark, sf)))
    fitted = training.train(written_splits(spark, sf), SETTINGS)
    return reports.model_card(
        rounded(found, *METRIC_COLUMNS),
        model.describe(fitted),
        {"max_length": SETTINGS.max_length, "seed": SETTINGS.seed},
        B.AS_OF.isoformat(),
    )


# Text rules


@query
def parse_kv(spark, sf):
    kv = B.kv_blocks(spark, sf).select("id", F.explode(X.parse_kv("text")))
    return kv.select("id", F.col("key").alias("k"), F.col("value").alias("v"))


@query
def patch_last_hunk(spark, sf):
    code = X.patch_code("patch", hunks="last")
    return B.patches(spark, sf).select("id", code.alias("code"))


@query
def patch_all_hunks(spark, sf):
    return B.patches(spark, sf).select("id", X.patch_code("patch").alias("code"))


@query
def patch_sides(spark, sf):
    return B.patches(spark, sf).select(
        "id", X.patch_code("patch", "- ").alias("buggy"), X.patch_code("patch", "+ ").alias("fixed")
    )


@query
def function_window(spark, sf):
    line_no = (F.col("n_chars") % 40).cast("int")
    code = X.function_window(B.code_like("code"), line_no, 3)
    return B.corpus(spark, sf).select("id", code.alias("code"))


@query
def function_name(spark, sf):
    return B.corpus(spark, sf).select("id", X.function_name(B.code_like("code")).alias("name"))


@query
def truncate_lines(spark, sf):
    return B.corpus(spark, sf).select("id", X.truncate_lines("code").alias("code"))


@query
def preview(spark, sf):
    # Cut before the rows are numbered, so no whole text is moved.
    short = B.corpus(spark, sf).select("id", X.preview("code").alias("preview"))
    return tokens.batches(short, PREVIEW_BATCH).select("batch", "slot", "id", "preview")


# Pairs


def usable(spark, sf):
    return pairs.usable_pairs(pairs.join_pairs(B.defects(spark, sf), B.fixes(spark, sf)))


@query
def pair_rows(spark, sf):
    name = F.lit("talk")
    return pairs.pair_rows(usable(spark, sf), name, name, F.concat_ws("_", name, "stem"))


@query
def drop_identical_pairs(spark, sf):
    return usable(spark, sf).select(
        "stem", "buggy_path", "fixed_path", F.length("buggy_code").alias("buggy_length")
    )


@query
def unpaired(spark, sf):
    return pairs.unpaired(B.defects(spark, sf), B.fixes(spark, sf)).select("stem", "path")


# Row rules


@query
def clean_only(spark, sf):
    return filters.clean_only(B.samples(spark, sf)).select("id", "source", "project", "pair_id")


@query
def request_rules(spark, sf):
    return B.corpus(spark, sf).select("id", filters.request_verdict("code").alias("reason"))


def batched_corpus(spark, sf):
    batch = F.concat_ws("/", "lang", F.expr("n_chars div 1000"))
    return B.corpus(spark, sf).select("id", batch.alias("batch_id"))


@query
def batch_size_rule(spark, sf):
    return filters.batch_sizes(batched_corpus(spark, sf), "batch_id")


@query
def accepted_batches(spark, sf):
    return filters.accepted_batches(batched_corpus(spark, sf), "batch_id")


@query
def batch_verdicts(spark, sf):
    return filters.batch_verdicts(batched_corpus(spark, sf), "batch_id")


@query
def graph_programs(spark, sf):
    return B.programs(spark, sf).withColumn("is_graph", filters.is_graph_program("program"))


# Splits


@query
def project_split_sorted(spark, sf):
    return splits.sorted_split(B.samples(spark, sf)).select("id", "project", "split")


@query
def project_split_seeded(spark, sf):
    return splits.seeded_split(B.samples(spark, sf), seed=SEED).select("id", "project", "split")


@query
def ratio_check(spark, sf):
    ok = splits.ratios_fit(F.col("train"), F.col("val"), F.col("test"))
    return B.ratio_settings(spark, sf).select("id", ok.alias("ok"))


# Profiles


@query
def split_stats(spark, sf):
    stats = profile.split_statistics(split_samples(spark, sf))
    return rounded(stats, "avg_length", "buggy_ratio")


@query
def length_profile(spark, sf):
    rows = B.corpus(spark, sf).select(
        F.col("lang").alias("split"), "code", (F.col("n_chars") % 2).alias("is_buggy")
    )
    return rounded(profile.length_profile(rows), "avg_length", "median_length", "buggy_ratio")


@query
def wide_stats(spark, sf):
    wide = profile.wide_statistics(split_samples(spark, sf))
    return rounded(wide, "avg_length", "median_length", "buggy_ratio")


@query
def length_bands(spark, sf):
    return profile.length_bands(profile.split_statistics(split_samples(spark, sf)))


@query
def balance_bands(spark, sf):
    return profile.balance_bands(profile.split_statistics(split_samples(spark, sf)))


@query
def overall_totals(spark, sf):
    stats = profile.split_statistics(split_samples(spark, sf))
    return rounded(profile.overall_totals(stats), "buggy_ratio")


@query
def extraction_summary(spark, sf):
    return profile.extraction_summary(B.samples(spark, sf))


@query
def project_counts(spark, sf):
    return profile.project_counts(B.samples(spark, sf))


# Metrics


@query
def attach_predictions(spark, sf):
    return rounded(preds(spark, sf), "score")


@query
def confusion(spark, sf):
    counts = metrics.confusion(preds(spark, sf))
    return rounded(counts, "score_sum")


@query
def overall_metrics(spark, sf):
    result = metrics.summary_metrics(metrics.confusion(preds(spark, sf)))
    return rounded(result, *METRIC_COLUMNS)


@query
def per_class_metrics(spark, sf):
    result = metrics.class_metrics(metrics.confusion(preds(spark, sf)))
    return rounded(result, *result.columns)


def project_metrics(spark, sf):
    counts = metrics.confusion(preds(spark, sf), ["project"])
    return metrics.summary_metrics(counts, ["project"])


@query
def per_project_metrics(spark, sf):
    return rounded(project_metrics(spark, sf), *METRIC_COLUMNS)


@query
def heldout_metrics(spark, sf):
    return rounded(metrics.split_and_overall_metrics(split_preds(spark, sf)), *METRIC_COLUMNS)


@query
def project_ranking(spark, sf):
    # Numbering reads its input several times, so the metrics are written first.
    path = f"{work_dir(spark)}/project_metrics"
    rounded(project_metrics(spark, sf), "f1_macro").write.parquet(path)
    return metrics.project_ranking(spark.read.parquet(path))


@query
def class_weights(spark, sf):
    return rounded(metrics.class_weights(B.samples(spark, sf)), "weight")


@query
def evaluation_report(spark, sf):
    return rounded(metrics.evaluation_report(split_preds(spark, sf)), *METRIC_COLUMNS)


@query
def evaluation_document(spark, sf):
    report = rounded(metrics.evaluation_report(split_preds(spark, sf)), *METRIC_COLUMNS)
    return reports.evaluation_document(report)


@query
def score_logits(spark, sf):
    return scored_logits(spark, sf, None)


@query
def score_logits_biased(spark, sf):
    return scored_logits(spark, sf, (1.0, 2.0))


def scored_logits(spark, sf, prior):
    scored = B.logits(spark, sf).withColumn("s", model.score_logits(F.col("logits"), prior))
    return scored.select(
        "id",
        F.round(F.get("s.probabilities", F.lit(0)), 6).alias("p_clean"),
        F.round(F.get("s.probabilities", F.lit(1)), 6).alias("p_buggy"),
        "s.yhat",
        F.round("s.score", 6).alias("score"),
        "s.label",
    )


@query
def best_step(spark, sf):
    return rounded(history.best_step(B.history(spark, sf)), "f1")


@query
def early_stop(spark, sf):
    return rounded(history.early_stop(B.history(spark, sf)), "best_f1")


# Leaderboard


def board(spark, sf) -> DataFrame:
    tops = leaderboard.top_authors(B.commits(spark, sf), B.AS_OF)
    verified = verify_log.verified_ids(B.log_lines(spark, sf))
    return leaderboard.mark_verified(leaderboard.owners(tops), verified)


@query
def top_author(spark, sf):
    return leaderboard.top_authors(B.commits(spark, sf), B.AS_OF)


@query
def owner_fallback(spark, sf):
    return leaderboard.owners(leaderboard.top_authors(B.commits(spark, sf), B.AS_OF))


@query
def contributors(spark, sf):
    return leaderboard.contributor_counts(board(spark, sf))


@query
def leaderboard_all(spark, sf):
    return leaderboard.podium(leaderboard.contributor_counts(board(spark, sf)))


@query
def leaderboard_week(spark, sf):
    return leaderboard.podium(leaderboard.contributor_counts(board(spark, sf), week=True))


@query
def leaderboard_totals(spark, sf):
    return leaderboard.totals(board(spark, sf))


@query
def leaderboard_page(spark, sf):
    # Three parts of one page from one computed board.
    path = f"{work_dir(spark)}/board"
    board(spark, sf).write.parquet(path)
    written = spark.read.parquet(path)
    counts = leaderboard.contributor_counts
    return reports.leaderboard_page(
        "Bugs by contributor",
        leaderboard.podium(counts(written)),
        leaderboard.podium(counts(written, week=True)),
        leaderboard.totals(written),
    )


# Checks


@query
def validate_schema(spark, sf):
    return validate.schema_report(B.samples(spark, sf))


@query
def validate_domains(spark, sf):
    return validate.domain_violations(B.samples(spark, sf), B.SOURCES)


@query
def validate_length(spark, sf):
    return validate.length_report(B.corpus(spark, sf))


@query
def validate_predictions(spark, sf):
    raw = B.logits(spark, sf).select(
        "id", F.get("logits", F.lit(0)).alias("score"), X.label_text("is_buggy").alias("label")
    )
    return rounded(validate.prediction_violations(raw), "score")


@query
def validate_leakage(spark, sf):
    return validate.leakage_report(splits.sorted_split(B.samples(spark, sf)))


# Synthetic defects and augmentation


@query
def variant_rows(spark, sf):
    rows = variants.label_variants(variants.variant_rows(B.samples(spark, sf)))
    return rows.drop("code", "func_name")


@query
def mutation_plan(spark, sf):
    rows = variants.variant_rows(B.samples(spark, sf))
    return rows.select("id", "variant", variants.mutation_plan(SEED).alias("patterns"))


@query
def text_mutation(spark, sf):
    rows = variants.fan_out(B.corpus(spark, sf))
    code = variants.text_mutation(F.col("code"), SEED)
    return rows.select("id", "variant", F.md5(code).alias("code_md5"))


def code_rows(spark, sf) -> DataFrame:
    """Documents with block starts, and small functions."""
    marked = B.samples(spark, sf).withColumn("code", B.code_like("code"))
    return marked.unionByName(B.python_code(spark, sf))


@query
def pattern_mutation(spark, sf):
    rows = variants.variant_rows(code_rows(spark, sf))
    code = mutations.mutate(F.col("code"), variants.mutation_plan(SEED), SEED)
    return rows.select("id", "variant", F.md5(code).alias("code_md5"))


@query
def single_patterns(spark, sf):
    """Each pattern alone on every small function."""
    rows = B.python_code(spark, sf).select("id", F.lit(0).alias("variant"), "code")
    key = (F.col("id"), F.col("variant"), F.lit(1))
    made = F.array(
        *[
            F.struct(
                F.lit(name).alias("pattern"),
                mutations.mutated_by(name, F.col("code"), SEED, (*key, name)).alias("mutant"),
            )
            for name in mutations.PATTERNS
        ]
    )
    return rows.select("id", F.explode(made).alias("m")).select("id", "m.pattern", "m.mutant")


@query
def lexed_patterns(spark, sf):
    """Each rule alone on functions with strings, comments and blocks, every place drawn."""
    rows = B.lexed_code(spark, sf)
    mutants = lexed.changed_by_each(lexed.RULES, F.col("code"), SEED, lambda rule: (F.col("id"), F.lit(rule)))
    names = F.array(*[F.lit(rule) for rule in lexed.RULES])
    made = F.arrays_zip(names.alias("pattern"), mutants.alias("mutant"))
    return rows.select("id", F.explode(made).alias("m")).select("id", "m.pattern", "m.mutant")


@query
def generate_variants(spark, sf):
    made = variants.generate_variants(code_rows(spark, sf), seed=SEED)
    return made.withColumn("code_md5", F.md5("code")).drop("code", "func_name")


@query
def variant_summary(spark, sf):
    rows = B.samples(spark, sf)
    made = variants.generate_variants(rows, seed=SEED, mutator="text")
    return rounded(profile.variant_summary(filters.clean_only(rows), made), "per_sample")


@query
def merge_summary(spark, sf):
    rows = B.samples(spark, sf)
    made = variants.generate_variants(rows, seed=SEED, mutator="text")
    return rounded(profile.merge_summary(variants.merge(rows, made)), "buggy_percent")


@query
def shuffled_merge(spark, sf):
    path = f"{work_dir(spark)}/train"
    rows = training.enlarged_train(split_samples(spark, sf), SETTINGS, path, mutator="text")
    return rows.select(
        "pos", "id", "pair_id", "source", "is_buggy", "origin", F.md5("code").alias("code_md5")
    )


@query
def augment_whitespace(spark, sf):
    code = G.add_whitespace(F.col("code"), SEED)
    return B.corpus(spark, sf).select("id", F.md5(code).alias("code_md5"))


@query
def augment_comment(spark, sf):
    code = G.add_comment(F.col("code"), SEED)
    return B.corpus(spark, sf).select("id", F.md5(code).alias("code_md5"))


# Tokens


@query
def tokenise(spark, sf):
    return B.corpus(spark, sf).select("id", tokens.tokenise("code").alias("tokens"))


@query
def token_stats(spark, sf):
    return rounded(tokens.token_stats(B.corpus(spark, sf)), "avg_tokens")


@query
def token_sample_report(spark, sf):
    return tokens.sample_token_report(B.corpus(spark, sf))


@query
def vocab_size(spark, sf):
    return tokens.vocab_total(B.corpus(spark, sf))


@query
def vocabulary(spark, sf):
    return tokens.vocabulary(B.corpus(spark, sf))


def written_vocabulary(spark, rows, vocab_size=None):
    """The vocabulary as a job keeps it, since encoding reads it twice."""
    path = f"{work_dir(spark)}/vocabulary"
    tokens.vocabulary(rows, vocab_size=vocab_size).write.parquet(path)
    return spark.read.parquet(path)


def encoded_corpus(spark, sf, vocab_size=None):
    rows = B.corpus(spark, sf).select("id", "code")
    vocab = written_vocabulary(spark, rows, vocab_size)
    return tokens.encode(rows, vocab), vocab


@query
def encode(spark, sf):
    return encoded_corpus(spark, sf)[0]


@query
def encode_small_vocabulary(spark, sf):
    return encoded_corpus(spark, sf, vocab_size=200)[0]


@query
def decode(spark, sf):
    rows, vocab = encoded_corpus(spark, sf)
    path = f"{work_dir(spark)}/windows"
    rows.write.parquet(path)
    return tokens.decode(spark.read.parquet(path), vocab)


@query
def batches(spark, sf):
    return tokens.batches(B.corpus(spark, sf).select("id", "project"), BATCH)


@query
def pad_batches(spark, sf):
    rows = B.corpus(spark, sf).select("id", "code")
    path = f"{work_dir(spark)}/texts"
    tokens.encode_texts(rows, written_vocabulary(spark, rows)).write.parquet(path)
    return tokens.pad_batches(tokens.window_batches(spark.read.parquet(path), BATCH))


@query
def encoded_rows(spark, sf):
    return training.encoded_rows(written_splits(spark, sf), SETTINGS)


# Model


@query
def train_and_score(spark, sf):
    rows = written_splits(spark, sf)
    return training.score_table(training.train(rows, SETTINGS), rows)


@query
def train_and_evaluate(spark, sf):
    rows = written_splits(spark, sf)
    return training.evaluate(training.train(rows, SETTINGS), rows)


@query
def train_counts(spark, sf):
    """The classifier in closed form, as fitted on the train split."""
    return training.train(written_splits(spark, sf), COUNTS)


@query
def score_counts(spark, sf):
    rows = written_splits(spark, sf)
    return rounded(training.score_table(training.train(rows, COUNTS), rows), "score")


@query
def evaluate_counts(spark, sf):
    rows = written_splits(spark, sf)
    return rounded(training.evaluate(training.train(rows, COUNTS), rows), *METRIC_COLUMNS)


@query
def saved_model_scores(spark, sf):
    """Whether a saved and loaded model gives each row the score it gave before."""
    rows = written_splits(spark, sf)
    fitted = training.train(rows, SETTINGS)
    path = f"{work_dir(spark)}/model"
    model.save(fitted, path)
    before = training.score_table(fitted, rows).select("id", "yhat", "score")
    after = training.score_table(model.load(path), rows)
    after = after.select("id", F.col("yhat").alias("_yhat"), F.col("score").alias("_score"))
    same = (F.col("yhat") == F.col("_yhat")) & (F.abs(F.col("score") - F.col("_score")) < 1e-9)
    return before.join(after, "id").select("id", same.alias("same"))


@query
def batch_replies(spark, sf):
    """One reply per row of a batch: place, preview, label and score, or why it has none."""
    rows = B.corpus(spark, sf).select("id", "lang", "n_chars", "code")
    batch = F.concat_ws("/", "lang", F.expr("n_chars div 1000"))
    requests = rows.select("id", batch.alias("batch_id"), "code")
    fitted = training.train(written_splits(spark, sf), SETTINGS)
    replies = scoring.batch_replies(requests, fitted, "batch_id")
    scored = F.col("label").isNotNull()
    return replies.select("batch_id", "slot", "id", "preview", "reason", scored.alias("scored"))


# Whole jobs


@query
def prepare_job(spark, sf):
    """From two written source trees to the written split table."""
    root = work_dir(spark)
    B.write_code_dirs(spark, sf, f"{root}/code")
    B.write_bug_tree(spark, sf, f"{root}/bugs")
    settings = dataset.DataSettings(f"{root}/bugs", f"{root}/code", f"{root}/out")
    return dataset.prepare(spark, settings).drop("func_name")


@query
def prepare_job_stats(spark, sf):
    """The statistics file that the same job leaves."""
    root = work_dir(spark)
    B.write_code_dirs(spark, sf, f"{root}/code")
    B.write_bug_tree(spark, sf, f"{root}/bugs")
    dataset.prepare(spark, dataset.DataSettings(f"{root}/bugs", f"{root}/code", f"{root}/out"))
    stats = reports.load_stats(spark, f"{root}/out/stats")
    return stats.select("split", "samples", "buggy", "clean")


@query
def training_job(spark, sf):
    """Enlarge, train and evaluate; the written report without the model's own numbers."""
    report = training.run(written_splits(spark, sf), SETTINGS, f"{work_dir(spark)}/run")
    return report.select("section", "name", "samples", "buggy_samples", "clean_samples")


def streamed(spark, sf) -> DataFrame:
    """All documents, scored as a stream by a model fitted on the train split."""
    fitted = training.train(written_splits(spark, sf), SETTINGS)
    documents = B.table(spark, sf, "documents")
    # A pattern, so that the table may be one file or a folder of files.
    arriving = (
        spark.readStream.schema(documents.schema)
        .option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        .parquet(f"{sf}/documents.parque[t]")
    )
    requests = arriving.select("doc_id", "text").toDF("id", "code")
    root = work_dir(spark)
    scoring.start_scoring(requests, fitted, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_score(spark, sf):
    return streamed(spark, sf)


@query
def stream_verdicts(spark, sf):
    """What the stream decides without the model, and which rows the model gave a label."""
    labelled = F.col("label").isNotNull() & F.col("score").isNotNull()
    return streamed(spark, sf).select("id", "status", "reason", labelled.alias("labelled"))


@query
def stream_batches(spark, sf):
    """What a stream of batches decides: rows arrive in several files, batches across them."""
    root = work_dir(spark)
    batch = F.concat_ws("/", "lang", F.expr("n_chars div 1000"))
    arrived = F.timestamp_seconds(F.lit(86_400) + F.col("id") % 3600)
    corpus = B.corpus(spark, sf).select("id", batch.alias("batch_id"), "code", arrived.alias("arrived"))
    corpus.repartition(STREAM_FILES).write.parquet(f"{root}/in")
    # A later row without an id closes what is open.
    last = spark.range(1).select(F.timestamp_seconds(F.lit(1 << 20)).alias("arrived"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("id", "bigint"), ("batch_id", "string"), ("code", "string"))]
    last.select(*none, "arrived").coalesce(1).write.mode("append").parquet(f"{root}/in")
    arriving = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", STREAM_FILES // 2)
    arriving = arriving.parquet(f"{root}/in")
    stream_rule.start_batches(arriving, "batch_id", "arrived", f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", F.col("batch").alias("batch_id"), "status", "reason")
