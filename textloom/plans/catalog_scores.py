"""Named queries: stems and posts, prediction scores, text overlap, job logs."""

from pyspark.sql import functions as F

from textloom.functions import stem as st
from textloom.functions import text as tx
from textloom.functions import tweets as tw
from textloom.operators import datasets as ds
from textloom.operators import joblog as jl
from textloom.operators import metrics as mt
from textloom.operators import overlap as ov
from textloom.operators import vocab as vc
from textloom.plans.catalog_corpus import cleaned
from textloom.plans.catalog_learning import QA_PAIRS
from textloom.plans.registry import query, table
from textloom.plans.sqltext import WS, words
from textloom.session import spread

# ---------------------------------------------------------------- stems and posts


@query("porter_stem")
def porter_stem(spark, sf):
    """Stems of the distinct words."""
    counts = vc.word_counts(cleaned(spark, sf), tx.words(F.col("content_clean")))
    return counts.select("word", "n", st.stem_column(F.col("word")).alias("stem"))


@query("tweet_tokenize")
def tweet_tokenize(spark, sf):
    posts = table(spark, sf, "conversations")
    marked = F.concat(F.lit("@handle "), "text", F.lit(" soooo good :-)"))
    return posts.select("conv_id", "turn", F.array_join(tw.tweet_tokens(marked), " ").alias("tokens"))


@query("process_tweet")
def process_tweet(spark, sf):
    posts = spread(table(spark, sf, "conversations"))
    return posts.select("conv_id", "turn", F.array_join(tw.process_tweet(F.col("text")), " ").alias("stems"))


# ---------------------------------------------------------------- labels against predictions


def judged(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


CLASS_SCORES = """
  cells AS (SELECT quality AS label, toxic AS predicted, COUNT(*) AS n FROM labels GROUP BY 1, 2),
  cls AS (SELECT DISTINCT unnest([label, predicted]) AS class FROM cells),
  s AS (SELECT class, COALESCE((SELECT SUM(n) FROM cells WHERE label = class AND predicted = class), 0) AS tp,
               COALESCE((SELECT SUM(n) FROM cells WHERE label = class), 0) AS support,
               COALESCE((SELECT SUM(n) FROM cells WHERE predicted = class), 0) AS guessed FROM cls),
  pr AS (SELECT CAST(class AS VARCHAR) AS class, tp, support, CASE WHEN guessed > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS precision,
                CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM s),
  sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(
    "classification_metrics",
    f"""WITH {CLASS_SCORES} SELECT round(SUM(tp) / SUM(support)::DOUBLE, 6) AS accuracy, round(SUM(precision * support) / SUM(support), 6) AS precision,
               round(SUM(recall * support) / SUM(support), 6) AS recall, round(SUM(f1 * support) / SUM(support), 6) AS f1_score FROM sc""",
)
def classification_metrics(spark, sf):
    return rounded(mt.classification_metrics(judged(spark, sf), "prediction", "label"), "accuracy", "precision", "recall", "f1_score")


@query(
    "classification_report",
    f"""WITH {CLASS_SCORES}, r AS (SELECT class, precision, recall, f1, support FROM sc
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), SUM(support) FROM sc
          UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support) FROM sc)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""",
)
def classification_report(spark, sf):
    return rounded(mt.classification_report(judged(spark, sf), "prediction", "label"), "precision", "recall", "f1")


@query(
    "binary_scores",
    f"WITH {CLASS_SCORES} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sc WHERE class = '1'",
)
def binary_scores(spark, sf):
    return rounded(mt.binary_scores(judged(spark, sf), "prediction", "label"), "precision", "recall", "f1")


@query("simple_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def simple_accuracy(spark, sf):
    return rounded(mt.simple_accuracy(judged(spark, sf), "prediction", "label"), "accuracy")


@query(
    "confusion_matrix",
    f"""WITH {CLASS_SCORES} SELECT a.class AS label, b.class AS predicted, COALESCE(n, 0) AS n
        FROM cls a CROSS JOIN cls b LEFT JOIN cells ON label = a.class AND predicted = b.class""",
)
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(judged(spark, sf), "prediction", "label")


@query("argmax_labels", "SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS predicted FROM embeddings")
def argmax_labels(spark, sf):
    logits = table(spark, sf, "embeddings")
    return logits.select("vec_id", "label", mt.predicted_label(logits, "embedding").alias("predicted"))


@query(
    "regression_metrics",
    """WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)
       SELECT round(avg((p - y) * (p - y)), 2) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
              round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2 FROM e""",
)
def regression_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1500.0)).alias("p"))
    return rounded(mt.regression_metrics(rows, "p", "y"), "rmse", "mae", "r2").withColumn("mse", F.round("mse", 2))


@query("perplexity", "SELECT round(exp(avg(value / 100)), 6) AS perplexity, round(avg(value / 100), 6) AS avg_loss FROM events")
def perplexity(spark, sf):
    losses = table(spark, sf, "events").select((F.col("value") / 100).alias("loss"))
    return rounded(mt.perplexity(losses, "loss"), "perplexity", "avg_loss")


# ---------------------------------------------------------------- answers against references


def answers(spark, sf):
    """(conv_id, turn, prediction, reference): assistant replies against the user's words."""
    pairs = ds.question_answer_pairs(table(spark, sf, "conversations"))
    return spread(pairs.select("conv_id", "turn", F.col("output").alias("prediction"), F.col("input").alias("reference")))


@query(
    "token_intersection",
    f"""WITH {QA_PAIRS} SELECT conv_id, turn, len(list_distinct({words('output')})) AS n_left, len(list_distinct({words('input')})) AS n_right,
               len(list_intersect({words('output')}, {words('input')})) AS n_common FROM qa""",
)
def token_intersection(spark, sf):
    sizes = mt.token_overlap(tx.words(F.col("prediction")), tx.words(F.col("reference")))
    return answers(spark, sf).select("conv_id", "turn", *[c.cast("bigint").alias(n) for n, c in sizes.items()])


@query(
    "qa_em_f1",
    f"""WITH {QA_PAIRS}, o AS (SELECT output = input AS em, len(list_distinct({words('output')}))::DOUBLE AS a, len(list_distinct({words('input')}))::DOUBLE AS b,
               len(list_intersect({words('output')}, {words('input')}))::DOUBLE AS c FROM qa)
        SELECT round(avg(CASE WHEN em THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
               round(avg(CASE WHEN c > 0 THEN 2 * (c / a) * (c / b) / (c / a + c / b) ELSE 0 END), 6) AS f1_score FROM o""",
)
def qa_em_f1(spark, sf):
    return rounded(mt.qa_em_f1(answers(spark, sf), "prediction", "reference", tx.words), "exact_match", "f1_score")


BLEU_TOKENS = rf"regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+|[^\p{{{{L}}}}\p{{{{N}}}}_{WS.replace('{', '{{').replace('}', '}}')}]')"
GRAM = "array_to_string(list_slice({0}, i, i + n - 1), ' ')"

BLEU = f"""WITH {QA_PAIRS},
  t AS (SELECT conv_id, turn, {BLEU_TOKENS.format('output')} AS p, {BLEU_TOKENS.format('input')} AS r FROM qa),
  o AS (SELECT unnest([1, 2, 3, 4]) AS n),
  pg AS (SELECT conv_id, turn, n, {GRAM.format('p')} AS g, COUNT(*) AS c FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM t, o) GROUP BY ALL),
  rg AS (SELECT conv_id, turn, n, {GRAM.format('r')} AS g, COUNT(*) AS c FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM t, o) GROUP BY ALL),
  m AS (SELECT n, SUM(least(pg.c, rg.c)) AS m FROM pg JOIN rg USING (conv_id, turn, n, g) GROUP BY n),
  d AS (SELECT n, SUM(greatest(len(p) - n + 1, 1)) AS d FROM t, o GROUP BY n),
  x AS (SELECT n, m / d::DOUBLE AS pn FROM d JOIN m USING (n)),
  b AS (SELECT CASE WHEN SUM(len(p)) > SUM(len(r)) THEN 1 ELSE exp(1 - SUM(len(r)) / SUM(len(p))::DOUBLE) END AS bp FROM t)
  SELECT """ + ", ".join(
    f"round(COALESCE((SELECT bp * exp({w} * SUM(ln(pn))) FROM x, b WHERE n <= {k} GROUP BY bp HAVING COUNT(*) = {k}), 0), 6) AS bleu{k}"
    for k, w in ((1, 1.0), (2, 0.5), (3, 0.33), (4, 0.25))
)


@query("corpus_bleu", BLEU)
def corpus_bleu(spark, sf):
    tokens = ov.punctuated_tokens
    lengths = [F.coalesce(F.length(c), F.lit(0)) for c in ("prediction", "reference")]
    scores = ov.corpus_bleu(answers(spark, sf), ["conv_id", "turn"], tokens(F.col("prediction")), tokens(F.col("reference")), sum(lengths, F.lit(0)))
    return rounded(scores, *scores.columns)


ROUGE_TOKENS = "regexp_extract_all(replace({}, '.', ' '), '[^" + WS.replace("{", "{{").replace("}", "}}") + "]+')"
BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


def _rouge_columns(n: int, p: str, r: str) -> str:
    common = f"len(list_intersect({p}, {r}))::DOUBLE"
    return (
        f"CASE WHEN len({p}) > 0 THEN {common} / len(list_distinct({p})) ELSE 0 END AS p{n}, "
        f"CASE WHEN len({r}) > 0 THEN {common} / len(list_distinct({r})) ELSE 0 END AS r{n}"
    )


ROUGE_N = f"""WITH {QA_PAIRS},
  t AS (SELECT {ROUGE_TOKENS.format('output')} AS p, {ROUGE_TOKENS.format('input')} AS r FROM qa),
  g AS (SELECT p, r, {BIGRAMS.format('p')} AS pp, {BIGRAMS.format('r')} AS rr FROM t),
  s AS (SELECT {_rouge_columns(1, 'p', 'r')}, {_rouge_columns(2, 'pp', 'rr')} FROM g)
  SELECT """ + ", ".join(
    f"round(avg(p{n}), 6) AS rouge{n}_p, round(avg(r{n}), 6) AS rouge{n}_r, round(avg(2 * p{n} * r{n} / (p{n} + r{n} + 1e-8)), 6) AS rouge{n}_f"
    for n in (1, 2)
) + " FROM s"


@query("rouge_n", ROUGE_N)
def rouge_n(spark, sf):
    scores = ov.rouge_n(answers(spark, sf), ov.rouge_tokens(F.col("prediction")), ov.rouge_tokens(F.col("reference")))
    return rounded(scores, *scores.columns)


@query("rouge_l")
def rouge_l(spark, sf):
    return ov.rouge_l(answers(spark, sf), F.col("prediction"), F.col("reference"))


@query("rouge_fmeasure")
def rouge_fmeasure(spark, sf):
    return ov.rouge_fmeasure(answers(spark, sf), "prediction", "reference")


@query("meteor")
def meteor(spark, sf):
    return ov.meteor(answers(spark, sf), ov.punctuated_tokens(F.col("prediction")), ov.punctuated_tokens(F.col("reference")))


# ---------------------------------------------------------------- job logs (events as jobs)

# Fixed mapping of event types to job states.
STATES = {"click": "completed", "error": "failed", "view": "running", "purchase": "cancelled", "signup": "pending"}
STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"

JOBS = f"""
  jobs AS (SELECT event_id AS job_id, user_id, user_id AS worker_id, {STATE_SQL} AS status, ts AS created_at, value AS seconds,
                  least(value, 100) AS progress, day(ts) AS epoch FROM events)"""


def jobs(spark, sf):
    """One job per event: its value is the run time in seconds."""
    pairs = [F.lit(x) for kv in STATES.items() for x in kv]
    started = F.col("ts").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 1_000_000).cast("bigint"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), "user_id", F.col("user_id").alias("worker_id"), F.create_map(*pairs)[F.col("event_type")].alias("status"),
        F.col("ts").alias("created_at"), started.alias("started_at"), ended.alias("completed_at"), F.col("value").alias("seconds"),
        F.least("value", F.lit(100.0)).alias("progress"), F.dayofmonth("ts").alias("epoch"),
    )


@query("status_counts", f"WITH {JOBS} SELECT status, COUNT(*) AS n FROM jobs GROUP BY 1 UNION ALL SELECT 'total', COUNT(*) FROM jobs")
def status_counts(spark, sf):
    return jl.status_counts(jobs(spark, sf))


@query("avg_duration", f"WITH {JOBS} SELECT round(COALESCE(avg(seconds), 0), 4) AS average_duration FROM jobs WHERE status = 'completed'")
def avg_duration(spark, sf):
    return jl.avg_duration(jobs(spark, sf)).withColumn("average_duration", F.round("average_duration", 4))


@query(
    "worker_rollup",
    f"""WITH {JOBS} SELECT worker_id, COUNT(*) AS jobs_processed, COUNT(*) FILTER (WHERE status = 'failed') AS jobs_failed,
               round(avg(seconds), 6) AS avg_processing_time FROM jobs GROUP BY 1""",
)
def worker_rollup(spark, sf):
    return rounded(jl.worker_rollup(jobs(spark, sf)), "avg_processing_time")


@query(
    "overall_progress",
    f"""WITH {JOBS} SELECT user_id, round(avg(CASE status WHEN 'completed' THEN 100 WHEN 'running' THEN progress ELSE 0 END), 6) AS overall_progress
        FROM jobs GROUP BY 1""",
)
def overall_progress(spark, sf):
    return rounded(jl.overall_progress(jobs(spark, sf), "user_id"), "overall_progress")


def batches(spark, sf):
    """Training batches: one per job, its value as loss, right when completed."""
    done = (F.col("status") == "completed").cast("int")
    split = F.when(F.col("job_id") % 5 == 0, "eval").otherwise("train")
    return jobs(spark, sf).select(
        "job_id", F.col("user_id").alias("run"), "epoch", split.alias("split"), (F.col("seconds") / 100).alias("loss"),
        done.alias("correct"), F.lit(1).alias("seen"), "seconds", "status",
    )


@query(
    "epoch_rollup",
    f"""WITH {JOBS} SELECT user_id AS run, epoch, CASE WHEN job_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, round(avg(seconds / 100), 6) AS loss,
               round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM jobs GROUP BY 1, 2, 3""",
)
def epoch_rollup(spark, sf):
    return rounded(jl.epoch_rollup(batches(spark, sf)), "loss", "accuracy")


@query(
    "method_rollup",
    f"""WITH {JOBS}, m AS (SELECT status AS method, epoch, job_id, progress / 100 AS accuracy, seconds, epoch / 2.0::DOUBLE AS pct FROM jobs)
        SELECT method, round(arg_max(accuracy, epoch * 1000000000 + job_id), 6) AS final_accuracy, round(SUM(seconds), 2) AS total_training_time,
               round(avg(seconds), 6) AS avg_epoch_time, round(1 - max(pct) / 100, 6) AS efficiency FROM m GROUP BY 1""",
)
def method_rollup(spark, sf):
    rows = jobs(spark, sf).select(
        F.col("status").alias("method"), "epoch", F.col("job_id").alias("row_id"), (F.col("progress") / 100).alias("accuracy"),
        "seconds", (F.col("epoch") / 2).alias("trainable_percentage"),
    )
    rolled = jl.method_rollup(rows).withColumn("total_training_time", F.round("total_training_time", 2))
    return rounded(rolled, "final_accuracy", "avg_epoch_time", "efficiency")


@query(
    "optimization_rollup",
    f"""WITH {JOBS} SELECT status AS variant, round(avg(CASE WHEN progress >= 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               round(max(user_id * 100000) * 4 / 1048576.0::DOUBLE, 6) AS model_size_mb, round(COUNT(*) / SUM(seconds), 6) AS throughput FROM jobs GROUP BY 1""",
)
def optimization_rollup(spark, sf):
    rows = jobs(spark, sf).select(
        F.col("status").alias("variant"), (F.col("progress") >= 50).cast("int").alias("correct"), F.lit(1).alias("seen"), "seconds",
        (F.col("user_id") * 100_000).alias("param_count"),
    )
    return rounded(jl.optimization_rollup(rows), "accuracy", "model_size_mb", "throughput")


@query("training_speed", f"WITH {JOBS} SELECT epoch, round(COUNT(*) / SUM(seconds), 6) AS samples_per_second FROM jobs GROUP BY 1")
def training_speed(spark, sf):
    totals = jobs(spark, sf).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s"))
    return totals.select("epoch", F.round(jl.training_speed(F.col("n"), F.col("s")), 6).alias("samples_per_second"))


HISTORY = f"{JOBS}, h AS (SELECT user_id AS run, epoch, round(avg(seconds), 6) AS score FROM jobs GROUP BY 1, 2)"


def history(spark, sf):
    scores = jobs(spark, sf).groupBy(F.col("user_id").alias("run"), "epoch").agg(F.round(F.avg("seconds"), 6).alias("score"))
    return scores


@query(
    "best_epoch",
    f"""WITH {HISTORY} SELECT run, epoch AS best_epoch, score AS best_score
        FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN run % 2 = 0 THEN -score ELSE score END, epoch) AS rk
              FROM h) WHERE rk = 1""",
)
def best_epoch(spark, sf):
    """Even runs have an accuracy and are judged by it, the others by their perplexity."""
    score = F.col("score")
    metrics = history(spark, sf).select("run", "epoch", F.when(F.col("run") % 2 == 0, score).alias("accuracy"), score.alias("perplexity"))
    return jl.best_epoch(metrics)


@query("early_stop", f"WITH {HISTORY} SELECT run, COUNT(*) > 3 AND arg_max(score, epoch) < max(score) - 0.01 AS stop FROM h GROUP BY 1")
def early_stop(spark, sf):
    return jl.early_stop(history(spark, sf))


@query("running_best", f"WITH {HISTORY} SELECT run, epoch, score, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far FROM h")
def running_best(spark, sf):
    return jl.running_best(history(spark, sf))


@query(
    "list_jobs",
    f"""WITH {JOBS}, f AS (SELECT * FROM jobs WHERE status = 'completed')
        SELECT job_id, user_id, status, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100""",
)
def list_jobs(spark, sf):
    return jl.list_jobs(jobs(spark, sf), 50, 100, status="completed").select("job_id", "user_id", "status", "total")


@query("tail_logs", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_logs(spark, sf):
    return jl.tail_logs(table(spark, sf, "events"), 100, "ts", "event_id").select("event_id", "event_type", "value")
