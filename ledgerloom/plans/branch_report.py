"""Gated branch report: check the tables, fold to branches, write the report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators.aggregates import by_branch
from ledgerloom.operators.quality import gate, run_checks
from ledgerloom.plans.operational import Frames
from ledgerloom.sinks.reports import write_branch_report

BRANCH_SQL = """
SELECT a.branch_id,
       CAST(SUM(t.n) AS BIGINT) AS transaction_count,
       SUM(t.gross) AS gross_amount,
       SUM(t.net) AS net_cash_flow
FROM (
    SELECT account_id, COUNT(*) AS n, SUM(amount) AS gross,
           SUM(CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE -amount END) AS net
    FROM {tx} GROUP BY account_id
) t
JOIN {account} a ON t.account_id = a.account_id
GROUP BY a.branch_id
"""


def branch_summary(t: Frames) -> DataFrame:
    return by_branch(t.tx, t.account)


def branch_summary_sql(t: Frames) -> DataFrame:
    """The same figures written as SQL."""
    return t.tx.sparkSession.sql(BRANCH_SQL, tx=t.tx, account=t.account)


def run_branch_report(t: Frames, base: str) -> dict:
    """A failing check raises before anything is written."""
    gate(run_checks(t.tx, t.account, t.customer, t.branch))
    return write_branch_report(branch_summary(t), base)
