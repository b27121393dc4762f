"""Checks of records as boolean expressions; ``where(~check)`` finds the bad rows, ``ensured`` makes one an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_ID, DIGEST, PUBLISH_KEY = "^[a-z0-9]{15}$", "^[a-f0-9]{64}$", "^[a-z0-9]+(?:-[a-z0-9]+)*$"
MOST_VERSION = 999_999_999


def holds(check: Column) -> Column:
    """A check with null as no."""
    return F.coalesce(check, F.lit(False))


def ensured(rows: DataFrame, check: Column, what: str) -> DataFrame:
    """``rows`` if the check holds for all; else the query fails."""
    return rows.where(F.when(holds(check), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def record_id(value: Column) -> Column:
    """A record id: 15 lower-case letters and digits, blanks around it don't count."""
    return holds(F.trim(value).rlike(RECORD_ID))


def version(value: Column) -> Column:
    """A version number."""
    return holds(value.between(1, MOST_VERSION))


def artifact(task: Column, message: Column, number: Column, kind: Column) -> Column:
    """A reference to a published file."""
    return record_id(task) & record_id(message) & version(number) & holds(kind.isin("md", "pdf"))


def trigger(schema_version: Column, kind: Column, task: Column, checksum: Column) -> Column:
    """An event that asks for publishing: schema 2, kind task, a task id and a checksum in their exact form."""
    return holds(schema_version == 2) & holds(kind == "task") & holds(task.rlike(RECORD_ID)) & holds(checksum.rlike(DIGEST))


def flag(value: Column) -> Column:
    """A switch that is on unless it says otherwise."""
    return F.coalesce(value, F.lit(True))


def service_url(url: Column) -> Column:
    """An address that may be called: https, or http on this machine; without user, query and fragment."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    local = part("HOST").isin("localhost", "127.0.0.1", "[::1]", "::1")
    return holds((part("PROTOCOL") == "https") | ((part("PROTOCOL") == "http") & local)) & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull()


def bearer_token(header: Column, most: int = 16_384) -> Column:
    """The token of an authorization header, null if there is none or it is too long."""
    token = F.nullif(F.regexp_extract(F.trim(header), r"^Bearer\s+(\S+)$", 1), F.lit(""))
    return F.when(F.length(token) <= most, token)


def missing_keys(settings: Column, required: tuple[str, ...]) -> Column:
    """Required keys of a MAP<STRING, STRING> that are absent or blank, in order."""
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: F.trim(F.coalesce(F.try_element_at(settings, k), F.lit(""))) == "")


def response_ok(error: Column, status: Column, has_id: Column) -> Column:
    """Whether an answer of a batch is a success: no error; a 2xx status where there is a status, else an id."""
    return holds(error.isNull() & F.when(status.isNotNull(), status.between(200, 299)).otherwise(has_id))


def limits(columns: dict[str, tuple[int, int]]) -> Column:
    """Whether text columns keep their least and most code points; nulls have length 0."""
    checks = [F.length(F.coalesce(F.col(c), F.lit(""))).between(low, high) for c, (low, high) in columns.items()]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Empty and null values of the named text columns replaced."""
    return rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), value) for c, value in defaults.items()})


def owned(rows: DataFrame, owner: str, me: str) -> DataFrame:
    """The rows an owner may see."""
    return rows.where(F.col(owner) == me)


def redirect_lines(rules: DataFrame, order: str, most: int = 100) -> DataFrame:
    """One row, ``text``: a line "source destination 200" for each rule. None or more than ``most`` rules, a side that doesn't begin with a
    slash, and more than one * in a source are errors. At most ``most`` rules reach the aggregate."""
    site = holds(F.col("source").startswith("/") & F.col("destination").startswith("/"))
    one = F.regexp_count("source", F.lit(r"\*")) <= 1
    checked = ensured(ensured(rules, site, "rules must stay on the site"), one, "a source may have one * at most").orderBy(order).limit(most + 1)
    out = checked.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat_ws(" ", "source", "destination", F.lit("200")).alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return ensured(out, F.col("n").between(1, most), f"there must be between 1 and {most} rules").select(F.concat("text", F.lit("\n")).alias("text"))


def blob_key(task: Column, number: Column, message: Column, kind: Column) -> Column:
    """Where a published file is kept."""
    return F.concat(F.lit("documents/tasks/"), F.trim(task), F.lit("/v"), number.cast("string"), F.lit("/messages/"), F.trim(message), F.lit("/document."), kind)


def content_type(kind: Column) -> Column:
    """The MIME type of a published file."""
    return F.when(kind == "md", "text/markdown; charset=utf-8").when(kind == "pdf", "application/pdf")


def publish_key(existing: Column, slug: Column, identity: Column) -> Column:
    """The key that is kept once given: the existing one, else the slug (or document, where it isn't one of at most 96 characters) and the
    end of the id."""
    usable = F.when(slug.rlike(PUBLISH_KEY) & (F.length(slug) <= 96), slug).otherwise("document")
    return F.coalesce(F.nullif(existing, F.lit("")), F.concat(usable, F.lit("-"), F.right(identity, F.lit(6))))


def signed(asked_key: Column, asked_type: Column, key: Column, content_type: Column, url: Column, expires: Column) -> Column:
    """Whether the answer of a signer is for what was asked: the very key and type, a https address and a time that can be read."""
    return holds((asked_key == key) & (asked_type == content_type) & url.startswith("https://")) & expires.try_cast("timestamp").isNotNull()


def strong_secret(secret: Column, least: int = 16) -> Column:
    """Whether a shared secret is long enough."""
    return holds(F.length(secret) >= least)


def account(collection: Column, value: Column, wanted: str) -> Column:
    """The id of an authenticated record of the wanted collection, null for another or one without a proper id."""
    return F.when(holds(collection == wanted) & holds(value.rlike(RECORD_ID)), value)
