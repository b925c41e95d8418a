"""Registration and admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import EMAIL_VALID
from ..functions.scalars import lpad_keep, ticket_checksum, ts_ntz
from ..sources.io import scratch_path
from .common import as_list, join_on_hot_key, number_within_groups, pick_per_group

# The schema's CHECK lists, patterns and column lengths.
TENANT_SLUG = r"^[a-z0-9-]+$"
CATEGORY_COLOR = r"^#[0-9A-Fa-f]{6}$"
EVENT_STATUSES = ["draft", "published", "active", "completed", "cancelled"]
VISITOR_STATUSES = ["registered", "confirmed", "checked_in", "checked_out", "no_show", "cancelled"]
SUBSCRIPTION_STATUSES = ["active", "cancelled", "expired", "suspended", "trialing"]
BILLING_CYCLES = ["monthly", "yearly", "lifetime"]
STAFF_ROLES = ["owner", "admin", "manager", "staff", "viewer"]
PAYMENT_PROVIDERS = ["midtrans", "xendit", "stripe"]
PAYMENT_STATUSES = ["pending", "success", "failed", "cancelled", "expired", "challenge"]
BILLING_PERIODS = ["monthly", "yearly"]


# O11 ---------------------------------------------------------------------
def not_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0)


def fits(c: str, n: int) -> Column:
    """VARCHAR(n): at most n characters (NULL passes)."""
    return F.length(F.col(c)) <= n


def rule_sets() -> dict[str, list[tuple[str, Column]]]:
    """Named data-quality rules per table. A rule is violated when its
    condition is FALSE; NULL passes, as a CHECK constraint does, so
    required fields carry their own not-null rule."""
    return {
        "tenants": [
            ("name_required", not_blank("name")),
            ("name_length", fits("name", 255)),
            ("slug_required", not_blank("slug")),
            ("slug_length", fits("slug", 100)),
            ("slug_format", F.col("slug").rlike(TENANT_SLUG)),
            ("subdomain_length", fits("subdomain", 100)),
            ("subdomain_format", F.col("subdomain").rlike(TENANT_SLUG)),
        ],
        "occasions": [
            ("name_required", not_blank("event_name")),
            ("name_length", fits("event_name", 255)),
            ("slug_length", fits("slug", 255)),
            ("slug_format", F.col("slug").rlike(TENANT_SLUG)),
            ("status_enum", F.col("status").isin(EVENT_STATUSES)),
            ("end_after_start", F.col("end_time") > F.col("start_time")),
        ],
        "visitors": [
            ("name_required", not_blank("first_name")),
            ("name_length", fits("first_name", 255)),
            ("email_required", not_blank("email")),
            ("email_length", fits("email", 255)),
            ("email_format", F.col("email").rlike(EMAIL_VALID)),
            ("code_length", fits("registration_code", 50)),
            ("category_range", F.col("category_id").between(1, 4)),
            ("event_id_positive", F.col("event_id") >= 1),
            ("status_enum", F.col("status").isin(VISITOR_STATUSES)),
        ],
        "categories": [
            ("name_length", fits("name", 100)),
            ("code_length", fits("code", 10)),
            ("color_format", F.col("color").rlike(CATEGORY_COLOR)),
        ],
        "subscriptions": [
            ("status_enum", F.col("status").isin(SUBSCRIPTION_STATUSES)),
        ],
        "staff": [
            ("role_enum", F.col("role").isin(STAFF_ROLES)),
            ("email_required", not_blank("email")),
        ],
        "contacts": [
            ("phone_required", not_blank("phone")),
            ("email_format", F.col("email").rlike(EMAIL_VALID)),
        ],
        "payments": [
            ("provider_enum", F.col("provider").isin(PAYMENT_PROVIDERS)),
            ("status_enum", F.col("status").isin(PAYMENT_STATUSES)),
            ("billing_period_enum", F.col("billing_period").isin(BILLING_PERIODS)),
        ],
    }


def validate_rows(df: DataFrame, rules: Sequence[tuple[str, Column]] | str) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks, in rule order."""
    if isinstance(rules, str):
        rules = rule_sets()[rules]
    flags = [F.when(~cond, F.lit(name)) for name, cond in rules]
    return df.withColumn("violations", F.array_compact(F.array(*flags)))


# The schema's unique constraints.
UNIQUE_RULES = {
    "staff": [("unique_tenant_email", ("tenant_id", "email"))],
    "categories": [("unique_tenant_category_code", ("tenant_id", "code"))],
    "occasions": [("unique_tenant_event_slug", ("tenant_id", "slug"))],
    "visitors": [("unique_tenant_event_email", ("tenant_id", "event_id", "email")),
                 ("unique_tenant_registration_code", ("tenant_id", "registration_code"))],
    "payment_settings": [("unique_tenant_provider", ("tenant_id", "provider"))],
}


def uniqueness_violations(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] | str) -> DataFrame:
    """One row per broken unique rule and key: ``rule``, ``key`` (the key's
    values, joined by ``|``) and ``rows``, how many rows share it. A NULL in the
    key equals nothing. Rows are counted with map-side aggregation, so a value
    that most rows share is one row per task."""
    if isinstance(rules, str):
        rules = UNIQUE_RULES[rules]
    out = None
    for name, cols in rules:
        known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
        found = (df.where(known).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
                 .select(F.lit(name).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "rows"))
        out = found if out is None else out.unionByName(found)
    return out


# O15 ---------------------------------------------------------------------
def admit_checkins(requests: DataFrame, visitors: DataFrame, checkins: DataFrame,
                   keys=("visitor_id",), time_col: str = "scan_time") -> DataFrame:
    """Batch admission, in the order the check-in call tests things: a
    visitor already checked in -> rejected 'duplicate'; unknown visitor ->
    rejected 'not_found'; otherwise the earliest request per visitor in the
    batch is accepted (event taken from the visitor) and later ones are
    'duplicate'. ``request_id`` must identify a request uniquely (a retried
    request carries its own id). With ``keys=("tenant_id", "visitor_id")`` both
    lookups test the tenant, so another tenant's scan finds no visitor.

    Everything is decided per visitor first: the earliest request per visitor
    is a partial aggregation, and the batch's visitors are looked up (known,
    already checked in), so these joins see one row per visitor. Only the
    final labelling join touches every request; it splits visitors with very
    many requests and keeps NULL keys out of the join."""
    keys = as_list(keys)
    valid = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    known = visitors.select(*keys, F.col("event_id").alias("_event_id"),
                            F.lit(True).alias("_known"))
    seen = checkins.select(*keys).distinct().withColumn("_seen", F.lit(True))
    first = pick_per_group(requests.where(valid), keys, [F.col(time_col), F.col("request_id")], ["request_id"],
                           largest=False, count="_rows").withColumnRenamed("request_id", "_first_id")
    per_visitor = first.join(known, keys, "left").join(seen, keys, "left")
    r = join_on_hot_key(requests, per_visitor, keys, F.col("request_id"), "_rows")
    reason = (F.when(F.col("_seen"), "duplicate")
               .when(F.col("_known").isNull(), "not_found")
               .when(F.col("request_id") == F.col("_first_id"), F.lit(None).cast("string"))
               .otherwise("duplicate"))
    return (r.withColumn("reason", reason)
             .withColumn("decision", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
             .withColumn("event_id", F.col("_event_id"))
             .drop("_seen", "_known", "_first_id", "_event_id"))


def mark_checked_in(visitors: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """After admission the visitor's status becomes 'checked_in' (and
    updated_at is stamped), as the check-in call does; other visitors keep
    theirs. Uses O34's patch on the accepted visitor ids."""
    from .changes import apply_patch
    accepted = (decisions.where(F.col("decision") == "accepted")
                .select("visitor_id", F.lit("checked_in").alias("status")).distinct())
    return apply_patch(visitors, accepted, "visitor_id", as_of)


# O28 ---------------------------------------------------------------------
def assign_codes(new: DataFrame, existing: DataFrame, categories: DataFrame,
                 style: str = "saas", as_of: str | None = None,
                 order_by: Sequence[str] = ("registered_at", "visitor_id")) -> DataFrame:
    """Registration codes for new visitors that have none.

    ``saas``: category code + 2-digit year of ``as_of`` + number padded to
    4, numbered per tenant and category. ``single``: category code + number
    padded to 3, numbered per category over all tenants. Numbers continue
    from the largest numeric suffix already used with that prefix (a
    non-numeric suffix is ignored); longer numbers are never cut. The whole
    batch is numbered at once, in ``order_by``.
    """
    cats = (categories.select("category_id", F.col("code").alias("_cat_code")))
    if style == "saas":
        yy = F.date_format(ts_ntz(as_of), "yy") if as_of else F.date_format(F.current_date(), "yy")
        group, width = ["tenant_id", "category_id"], 4
    elif style == "single":
        yy, group, width = F.lit(""), ["category_id"], 3
    else:
        raise ValueError(f"unknown style {style!r}")
    prefix = F.concat(F.col("_cat_code"), yy)

    ex = existing.join(cats, "category_id", "inner").where(
        F.col("registration_code").startswith(prefix))
    suffix = F.substring(F.col("registration_code"), F.length(prefix) + 1, 1 << 30)
    number_used = F.when(suffix.rlike("^[0-9]+$"), suffix.try_cast("decimal(38,0)"))
    used = ex.groupBy(*group).agg(F.max(number_used).alias("_max"))
    # A row per tenant and category. Written, its size is known: sent whole if small, else Spark can split a hot group.
    path = scratch_path(new.sparkSession, "numbers_used")
    used.write.parquet(path)
    used = new.sparkSession.read.schema(used.schema).parquet(path)

    code = F.col("registration_code")
    needs = code.isNull() | (code == "")
    n = new.join(cats, "category_id", "left")
    todo = n.where(needs & F.col("_cat_code").isNotNull())
    keep = n.where(~(needs & F.col("_cat_code").isNotNull()))
    numbered = number_within_groups(todo, group, list(order_by), out="_seq")
    numbered = numbered.join(used, group, "left")
    number = (F.coalesce(F.col("_max"), F.lit(0).cast("decimal(38,0)")) + F.col("_seq")).cast("decimal(38,0)")
    numbered = numbered.withColumn("registration_code", F.concat(prefix, lpad_keep(number, width)))
    cols = new.columns
    return numbered.select(*cols).unionByName(keep.select(*cols))


# O29 ---------------------------------------------------------------------
def dedupe_registrations(df: DataFrame, keys=("tenant_id", "event_id", "email"),
                         order_by: Sequence[str] = ("registered_at", "visitor_id"),
                         id_col: str = "visitor_id") -> DataFrame:
    """Mark the first registration per key as kept; later ones point at it
    through ``duplicate_of``. Keys: (tenant, event, e-mail) as the schema's
    unique rule, or ``("email",)`` for the global check of the simple
    server. The first row per key is found by partial aggregation, and the
    labelling join deals the rows of one key to many tasks. A NULL in the key
    equals nothing (as in a unique constraint), so such rows are all kept."""
    keys = as_list(keys)
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    first = pick_per_group(df.where(known), keys, [F.col(c) for c in order_by], [id_col], largest=False, count="_rows") \
        .withColumnRenamed(id_col, "_first_id")
    out = join_on_hot_key(df, first, keys, F.col(id_col), "_rows")
    kept = F.col("_first_id").isNull() | (F.col(id_col) == F.col("_first_id"))
    return (out.withColumn("kept", kept)
               .withColumn("duplicate_of", F.when(~kept, F.col("_first_id")))
               .drop("_first_id"))


# O37 ---------------------------------------------------------------------
def ticket_payload(visitors: DataFrame, categories: DataFrame, key: str, as_of: str) -> DataFrame:
    """Per visitor with a code: the JSON ticket payload with its checksum, and the
    payload sealed with AES (GCM, random IV) under ``key`` (16/24/32 bytes),
    base64 encoded."""
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("ticket key must be 16, 24 or 32 bytes")
    cat = (categories.select("category_id", F.col("name").alias("_cat_name")))
    # A ticket needs a registration code (visitors without one get none).
    v = visitors.where(F.col("registration_code").isNotNull()).join(cat, "category_id", "left")
    checksum = ticket_checksum("visitor_id", "registration_code", "email")
    stamp = (F.unix_micros(ts_ntz(as_of).cast("timestamp")) / 1000).cast("long")
    payload = F.to_json(F.struct(
        F.col("visitor_id").alias("id"), F.col("registration_code").alias("registration_code"),
        F.concat_ws(" ", "first_name", "last_name").alias("nama_lengkap"),
        F.col("email").alias("email"), F.col("_cat_name").alias("category"),
        F.col("event_id").alias("event_id"), stamp.alias("timestamp"),
        checksum.alias("checksum")))
    sealed = F.base64(F.aes_encrypt(payload, F.lit(key), F.lit("GCM")))
    return v.select("visitor_id", "registration_code", checksum.alias("checksum"),
                    payload.alias("payload"), sealed.alias("sealed"))


TICKET_SCHEMA = ("id BIGINT, registration_code STRING, nama_lengkap STRING, email STRING, "
                 "category STRING, event_id BIGINT, timestamp BIGINT, checksum STRING")


def verify_tickets(tickets: DataFrame, key: str, sealed_col: str = "sealed") -> DataFrame:
    """Open sealed tickets in bulk and re-check their checksum. A ticket that
    does not decrypt (wrong key, tampered) or whose checksum differs is
    invalid."""
    opened = F.try_aes_decrypt(F.unbase64(F.col(sealed_col)), F.lit(key), F.lit("GCM"))
    t = tickets.withColumn("_json", opened.cast("string")) \
        .withColumn("_t", F.from_json("_json", TICKET_SCHEMA))
    recomputed = ticket_checksum(F.col("_t.id"), F.col("_t.registration_code"), F.col("_t.email"))
    valid = F.coalesce(F.col("_t.checksum") == recomputed, F.lit(False))
    return t.withColumn("ticket_id", F.col("_t.id")).withColumn("valid", valid).drop("_json", "_t")
