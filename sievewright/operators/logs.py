"""Log and error analytics: categories, retry decisions, descriptions, key-value lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.text import redact_secrets

_ERROR = "struct<error:struct<type:string,code:string,param:string,message:string,failed_generation:string>>"


def status(message: Column) -> Column:
    return F.regexp_extract(message, r"API ([0-9]{3})", 1).try_cast("int")


def category(message: Column) -> Column:
    """What kind of provider error a message tells of; a status code decides before words do."""
    s = status(message)
    return (
        F.when((s == 429) & message.rlike(r"(?i)tokens per day|\bTPD\b"), "provider_daily_limit")
        .when(s == 429, "rate_limited")
        .when(s >= 500, "server_error")
        .when(s >= 400, "client_error")
        .when(message.rlike("(?i)timeout|abort"), "timeout")
        .when(message.rlike("(?i)netwerkfout"), "network")
        .when(message.rlike("(?i)JSON-output|tool-antwoord|antwoordformaat"), "malformed_response")
        .when(message.rlike("(?i)niet geconfigureerd"), "not_configured")
        .otherwise("unknown")
    )


def retry(code: Column) -> Column:
    """Once for server errors, never for limits or the client's own."""
    return F.coalesce((code != 429) & (code >= 500), F.lit(False))


def described(code: Column, body: Column, request: Column, key: str = "", most: int = 800) -> Column:
    """One redacted line on an error answer: its JSON fields, else the body itself."""
    e = F.from_json(body, _ERROR)["error"]
    field = lambda n: F.when(F.coalesce(e[n], F.lit("")) != "", F.concat(F.lit(f"{n}="), e[n]))
    told = F.when(F.coalesce(e["message"], F.lit("")) != "", F.concat(F.lit("melding: "), e["message"]))
    plain = F.when(e.isNull() & (F.coalesce(body, F.lit("")) != ""), F.concat(F.lit("antwoord: "), body))
    asked = F.when(F.coalesce(request, F.lit("")) != "", F.concat(F.lit("request-id="), request))
    line = F.concat_ws(" ", F.concat(F.lit("HTTP "), code.cast("string")), field("type"), field("code"), field("param"), told, plain, asked)
    return F.substring(F.regexp_replace(redact_secrets(line, key), r"\s+", " "), 1, most)


def fields(line: Column) -> Column:
    """``k=v k=v`` as a map; the last of equal keys counts."""
    pairs = F.filter(F.split(line, r"\s+"), lambda p: F.instr(p, "=") > 1)
    key, value = (lambda p: F.substring_index(p, "=", 1)), (lambda p: F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    last = F.aggregate(pairs, F.expr("CAST(map() AS map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != key(p)), F.create_map(key(p), value(p))))
    return F.coalesce(last, F.expr("CAST(map() AS map<string,string>)"))


def limits(line: Column) -> dict[str, Column]:
    """Remaining tokens, their limit and the seconds to wait, from a header line; no numbers are null."""
    m = fields(line)
    return {n: m[k].try_cast("double") for n, k in (("remaining_tokens", "x-ratelimit-remaining-tokens"), ("limit_tokens", "x-ratelimit-limit-tokens"), ("retry_after", "retry-after"))}
