"""Yes/no questions about captured traffic (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import text as X
from webloom.functions import urls as U


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def verdict(status: Column) -> Column:
    """What a probe proves: only 404 and 410 prove absence."""
    return (
        F.when(status.isNull(), "unreachable").when(status.isin(404, 410), "missing").when(status < 400, "present").otherwise("blocked")
    )


def is_html(content_type: Column, body: Column) -> Column:
    low = F.regexp_replace(F.lower(F.left(_t(body), F.lit(600))), r"^\s+", "")
    return (
        F.lower(_t(content_type)).contains("text/html") | low.startswith("<!doctype html") | low.startswith("<html") | low.contains("<body")
    )


def is_auth_probe(resource_type: Column, status: Column, url: Column) -> Column:
    query = U.query_of(_t(url))
    where = F.concat(U.raw_path(_t(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(resource_type.isin("xhr", "fetch") & status.isin(400, 401, 403), F.lit(False)) & where.rlike(seeds.AUTH_PROBE_PATH)


def is_empty_answer(status: Column, body: Column) -> Column:
    message = X.answer_message(body)
    return status.isin(400, 404, 409, 422) & (_t(body) != "") & message.rlike(seeds.EMPTY_MESSAGE) & ~message.rlike(seeds.NOT_EMPTY_MESSAGE)


def ignorable_console(text: Column) -> Column:
    return _t(text).rlike(seeds.IGNORABLE_CONSOLE)


def clipboard_refusal(message: Column) -> Column:
    return _t(message).rlike("(?i)clipboard") & _t(message).rlike(seeds.CLIPBOARD_WHY)


def looks_offline(error: Column) -> Column:
    return _t(error).rlike("|".join(seeds.OFFLINE_MARKERS))


def is_search_form(action: Column, ident: Column, name: Column, field_names: Column) -> Column:
    return F.concat_ws(" ", _t(action), _t(ident), _t(name), _t(field_names)).rlike(seeds.SEARCH_FORM)
