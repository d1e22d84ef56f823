"""E2 + P22 + A13: call a pluggable judge, parse its verdicts into facts.

The judge is any ``callable(list[str]) -> list[str]`` (prompt texts in,
response texts out).  It runs inside ``mapInPandas`` so calls are spread
over executors; responses are checkpointed once, so a retried or branched
plan never calls the judge twice for the same case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_fences
from ..session import cut_lineage, ship_package
from .score import UNKNOWN_CHECK_TYPE

Scorer = Callable[[list[str]], list[str]]


def call_judge(prompts: DataFrame, scorer: Scorer, id_col: str = "instance_id",
               prompt_col: str = "prompt", partitions: int | None = None,
               persist: bool = True, store: str | None = None, run_id: str = "") -> DataFrame:
    """``id, prompt`` -> ``id, response, judge_error``.

    ``partitions`` bounds how many judge calls run at once.  The scorer gets
    one prompt a call, so an error fails only its own case (``judge_error``
    set, response NULL); no answer (None) is an error as well.

    ``store`` is a folder of answers by (id, md5 of the prompt).  Prompts that
    have one are not judged; new answers are added with ``run_id``, errors are
    not, so a later run asks again.  A prompt that changed has another md5.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    src = prompts.select(F.col(id_col).cast("string").alias(id_col), prompt_col, F.md5(prompt_col).alias("prompt_md5"))
    todo, known = src, None
    if store:
        known = read_responses(spark, store, id_col).join(src.select(id_col, "prompt_md5").distinct(), [id_col, "prompt_md5"], "left_semi")
        known = cut_lineage(known)  # what was known before this run adds to the store
        todo = src.join(known, [id_col, "prompt_md5"], "left_anti").dropDuplicates([id_col, "prompt_md5"])
    if partitions:
        todo = todo.repartition(partitions, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, err = [], []
            for text in pdf[prompt_col].tolist():
                try:
                    answer = list(scorer([text]))
                    if len(answer) != 1 or answer[0] is None:
                        raise ValueError("scorer gave no single response to a prompt")
                    out.append(answer[0])
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - a judge failure is data
                    out.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({id_col: pdf[id_col].tolist(), "prompt_md5": pdf["prompt_md5"].tolist(), "response": out, "judge_error": err}, dtype="object")

    res = todo.mapInPandas(run, f"{id_col} string, prompt_md5 string, response string, judge_error string")
    if persist or store:
        res = cut_lineage(res)
    if known is None:
        return res.drop("prompt_md5")
    (res.where(F.col("judge_error").isNull()).select(id_col, "prompt_md5", "response", F.lit(run_id).alias("run_id"))
     .write.mode("append").parquet(store))
    both = res.unionByName(known.select(id_col, "prompt_md5", "response", F.lit(None).cast("string").alias("judge_error")))
    return both.drop("prompt_md5")


def read_responses(spark: SparkSession, store: str, id_col: str = "instance_id") -> DataFrame:
    """Answers of a response store, one a prompt: ``id, prompt_md5, response, run_id``."""
    schema = f"{id_col} string, prompt_md5 string, response string, run_id string"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    # two runs at once may both have judged a prompt
    rows = spark.read.schema(schema).parquet(store).groupBy(id_col, "prompt_md5").agg(F.min(F.struct("run_id", "response")).alias("_a"))
    return rows.select(id_col, "prompt_md5", "_a.response", "_a.run_id")


def verdicts(responses: DataFrame, id_col: str = "instance_id", text_col: str = "response") -> DataFrame:
    """``id, eval_result``: the parsed verdict, or what was answered instead."""
    parsed = F.try_parse_json(strip_fences(F.col(text_col)))
    other = F.to_variant_object(F.struct(F.lit("verdict is no JSON").alias("error"), F.col(text_col).alias("raw_response")))
    return responses.select(id_col, F.coalesce(parsed, other).alias("eval_result"))


def parse_verdicts(responses: DataFrame, id_col: str = "instance_id",
                   text_col: str = "response") -> tuple[DataFrame, DataFrame, DataFrame]:
    """P22 + A13: judge text -> (status, checks, categories).

    Mirrors the reference's outcomes: unparsable text, or an object with an
    ``error`` key, scores 0 with success; a list/string holding ``"error"``
    likewise; other shapes that are not ``{category: {checks: [...]}}`` fail
    the case.  ``checks`` has one row per check; ``categories`` one row per
    category (for empty categories in the breakdown).
    """
    v = F.try_parse_json(strip_fences(F.col(text_col)))
    base = responses.select(id_col, text_col, v.alias("_v"))
    kind = F.schema_of_variant(F.col("_v"))
    base = base.withColumn("_kind", F.when(F.col("_v").isNull(), F.lit("NONE"))
                           .otherwise(F.regexp_extract(kind, r"^([A-Z]+)", 1)))
    obj = F.try_variant_get(F.col("_v"), "$", "map<string,variant>")
    base = base.withColumn("_obj", F.when(F.col("_kind") == "OBJECT", obj))
    arr = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    has_error_elem = F.exists(arr, lambda x: F.coalesce(F.try_variant_get(x, "$", "string") == "error", F.lit(False))
                              & (F.regexp_extract(F.schema_of_variant(x), r"^([A-Z]+)", 1) == "STRING"))
    str_val = F.try_variant_get(F.col("_v"), "$", "string")

    # per category: value must be an object; its checks (default []) an array of objects
    cats = base.where(F.col("_kind") == "OBJECT").select(
        id_col, F.explode(F.col("_obj")).alias("category", "_cv"))
    ckind = F.regexp_extract(F.schema_of_variant(F.col("_cv")), r"^([A-Z]+)", 1)
    checks_v = F.try_variant_get(F.col("_cv"), "$.checks", "variant")
    cats = cats.withColumn("_ck", ckind).withColumn("_checks_v", checks_v)
    chk_kind = F.regexp_extract(F.schema_of_variant(F.col("_checks_v")), r"^([A-Z]+)", 1)
    cats = cats.withColumn(
        "_bad",
        (F.col("_ck") != "OBJECT")
        | (F.col("_checks_v").isNotNull() & ~(
            (chk_kind == "ARRAY")
            | ((chk_kind == "STRING") & (F.try_variant_get(F.col("_checks_v"), "$", "string") == ""))
            | ((chk_kind == "OBJECT") & (F.size(F.try_variant_get(F.col("_checks_v"), "$", "map<string,variant>")) == 0)))))
    items = cats.where(~F.col("_bad")).select(
        id_col, "category",
        F.posexplode(F.try_variant_get(F.col("_checks_v"), "$", "array<variant>")).alias("check_pos", "_it"))
    it_kind = F.regexp_extract(F.schema_of_variant(F.col("_it")), r"^([A-Z]+)", 1)
    items = items.withColumn("_item_bad", it_kind != "OBJECT")
    bad_cases = (cats.where("_bad").select(id_col)
                 .unionByName(items.where("_item_bad").select(id_col))
                 .distinct().withColumn("_shape_bad", F.lit(True)))

    ct = F.try_variant_get(F.col("_it"), "$.check_type", "variant")
    checks = items.where(~F.col("_item_bad")).select(
        id_col, "category", "check_pos",
        F.try_variant_get(F.col("_it"), "$.check_id", "string").alias("check_id"),
        F.when(ct.isNull(), F.lit(UNKNOWN_CHECK_TYPE))
         .otherwise(F.try_variant_get(F.col("_it"), "$.check_type", "string")).alias("check_type"),
        F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.col("_it"), "$.result", "variant")),
                                r"^([A-Z]+)", 1) == "STRING",
               F.try_variant_get(F.col("_it"), "$.result", "string")).alias("result"))

    st = base.join(bad_cases, id_col, "left")
    none = F.col(text_col).isNull()  # no answer at all fails the case
    zero_ok = (((F.col("_kind") == "NONE") & ~none)
               | ((F.col("_kind") == "OBJECT") & F.map_contains_key(F.col("_obj"), "error"))
               | ((F.col("_kind") == "ARRAY") & F.coalesce(has_error_elem, F.lit(False)))
               | ((F.col("_kind") == "STRING") & F.coalesce(str_val.contains("error"), F.lit(False))))
    good_obj = (F.col("_kind") == "OBJECT") & F.col("_shape_bad").isNull()
    status = st.select(
        id_col,
        (zero_ok | good_obj).alias("success"),
        F.when(zero_ok, F.lit(True)).otherwise(F.lit(False)).alias("zero_reward"),
        F.when(zero_ok | good_obj, F.lit(None).cast("string"))
         .when(none, F.lit("judge gave no response"))
         .when(F.col("_kind") == "OBJECT", F.lit("verdict categories must hold objects with a list of check objects"))
         .otherwise(F.concat(F.lit("verdict must be a JSON object, got "), F.lower(F.col("_kind")))).alias("error"))
    ok_ids = status.where(F.col("success") & ~F.col("zero_reward")).select(id_col)
    checks = checks.join(ok_ids, id_col, "left_semi")
    categories = cats.where(~F.col("_bad")).select(id_col, "category").join(ok_ids, id_col, "left_semi")
    return status.drop("zero_reward"), checks, categories
