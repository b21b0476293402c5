"""op1: verdicts on page urls."""

from webloom.llm.registry import query, table
from webloom.llm.url_filter import RULES, judge_urls, rule_table

@query("op1_url_verdicts")
def op1_url_verdicts(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_table(spark, RULES))
