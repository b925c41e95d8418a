"""The log of provider notices (O40, O41, O02) with bodies of any shape.

Bodies and headers are kept as VARIANT: a field that a provider adds tomorrow is
stored and can be read by path, without a schema change. Each body is parsed
once, when it is logged. A notice that cannot be used is logged with an error,
and its text is kept as it came:

- ``malformed body``: no JSON text (a repeated key counts as such), or none at all;
- ``not an object``: JSON, but an array or a plain value;
- ``unknown provider``: no provider with such notices;
- ``no order id``: nothing to apply it to.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payments import FIRST_PROVIDER, SECOND_PROVIDER, payment_status

LOG = ("notice_id long, provider string, received_at timestamp_ntz, order_id string, tenant_id int, payload variant, headers variant, "
       "status_code int, error_message string, raw_body string")

# Answers to a notice.
STATUS_CODES = {"malformed body": 400, "not an object": 400, "unknown provider": 404, "no order id": 500}
OK = 200

# Where each provider puts a field.
PATHS = {
    "order_id": {FIRST_PROVIDER: "$.order_id", SECOND_PROVIDER: "$.external_id"},
    "provider_status": {FIRST_PROVIDER: "$.transaction_status", SECOND_PROVIDER: "$.status"},
    "fraud_status": {FIRST_PROVIDER: "$.fraud_status"},
    "amount": {FIRST_PROVIDER: "$.gross_amount", SECOND_PROVIDER: "$.amount"},
    "tenant_id": {FIRST_PROVIDER: "$.custom_field1", SECOND_PROVIDER: "$.metadata.tenant_id"},
    "plan_id": {FIRST_PROVIDER: "$.custom_field2", SECOND_PROVIDER: "$.metadata.plan_id"},
    "billing_period": {FIRST_PROVIDER: "$.custom_field3", SECOND_PROVIDER: "$.metadata.billing_period"},
}


def field(payload: Column | str, name: str, kind: str) -> Column:
    """The named field of a payload, by its provider's path; NULL where it is
    missing or not of that kind."""
    value = F.lit(None).cast(kind)
    for provider, path in PATHS[name].items():
        value = F.when(F.col("provider") == provider, F.try_variant_get(payload, path, kind)).otherwise(value)
    return value


def json_kind(value: Column | str) -> Column:
    """object, array, string, number, boolean or null."""
    s = F.schema_of_variant(value)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
             .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number"))


def log_notices(raw: DataFrame) -> DataFrame:
    """Rows of the log from raw notices: notice_id, provider, received_at, body
    and, if there is one, ``headers`` (JSON text; headers that are none are NULL)."""
    head = F.try_parse_json("headers") if "headers" in raw.columns else F.lit(None).cast("variant")
    # Behind a generator: no filter or second use of a field takes the parser along.
    once = F.inline(F.array(F.struct(F.try_parse_json("body").alias("payload"), head.alias("headers"))))
    parsed = raw.select("notice_id", "provider", "received_at", F.col("body").alias("_body"), once)
    named = parsed.withColumns({"order_id": field("payload", "order_id", "string"), "tenant_id": field("payload", "tenant_id", "int")})
    error = (F.when(F.col("payload").isNull(), "malformed body")
              .when(json_kind("payload") != "object", "not an object")
              .when(~F.coalesce(F.col("provider").isin(FIRST_PROVIDER, SECOND_PROVIDER), F.lit(False)), "unknown provider")
              .when(F.col("order_id").isNull() | (F.col("order_id") == ""), "no order id"))
    code = F.lit(OK)
    for message, n in STATUS_CODES.items():
        code = F.when(F.col("error_message") == message, n).otherwise(code)
    judged = named.withColumn("error_message", error).withColumn("status_code", code.cast("int"))
    return judged.select(F.col("notice_id").cast("long").alias("notice_id"), "provider", F.col("received_at").cast("timestamp_ntz").alias("received_at"),
                         "order_id", "tenant_id", "payload", "headers", "status_code", "error_message",
                         F.when(F.col("error_message").isNotNull(), F.col("_body")).alias("raw_body"))


def append(raw: DataFrame, path: str) -> None:
    log_notices(raw).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as written; empty before the first notice."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def failed(log: DataFrame) -> DataFrame:
    """Notices kept aside, with the text that came."""
    return log.where("error_message IS NOT NULL").select("notice_id", "provider", "received_at", "status_code", "error_message", "raw_body")


def usable(log: DataFrame, polled: bool = False) -> DataFrame:
    """The notices without an error as ``map_payment_status`` gives them, the
    payload as ``raw_response``; read from the log, no body is parsed again."""
    states = log.where("error_message IS NULL").select(
        "notice_id", "provider", "received_at", "order_id", field("payload", "provider_status", "string").alias("provider_status"),
        field("payload", "fraud_status", "string").alias("_fraud"), field("payload", "amount", "double").alias("amount"), "tenant_id",
        field("payload", "plan_id", "int").alias("plan_id"), field("payload", "billing_period", "string").alias("billing_period"),
        F.col("payload").alias("raw_response"))
    return states.select(
        "notice_id", "provider", "received_at", "order_id", "provider_status",
        payment_status("provider", "provider_status", "_fraud", polled=polled).alias("payment_status"),
        payment_status("provider", "provider_status", "_fraud", polled=True).alias("polled_status"),
        "amount", "tenant_id", "plan_id", "billing_period", "raw_response")


def fields_in_use(log: DataFrame, depth: int = 2) -> DataFrame:
    """(provider, path, kind, notices): every field of the usable payloads down to
    ``depth`` objects, and in how many notices it has that kind. A field that
    no reader knows yet shows up here."""
    level = log.where("error_message IS NULL").select("provider", F.lit("$").alias("path"), F.col("payload").alias("v"))
    found = None
    for _ in range(depth):
        inside = level.lateralJoin(log.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = inside.select("provider", F.concat_ws(".", "path", "key").alias("path"), json_kind("value").alias("kind"), F.col("value").alias("v"))
        counts = level.groupBy("provider", "path", "kind").agg(F.count(F.lit(1)).alias("notices"))
        found = counts if found is None else found.unionByName(counts)
        level = level.where("kind = 'object'").select("provider", "path", "v")
    return found


def schemas(log: DataFrame) -> DataFrame:
    """(provider, payload_schema): the type that all usable payloads of a provider have in common."""
    return log.where("error_message IS NULL").groupBy("provider").agg(F.schema_of_variant_agg("payload").alias("payload_schema"))
