"""Typed loads of the twelve bulk files of the state register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.readers import split_rejects, typed

#: The columns of each file, in order.
LAYOUTS = {
    "Committees": "id type_of_committee state_committee local_committee refer_name name address1 address2 address3 city state zipcode status status_date creation_date creation_amount disp_funds_return disp_funds_political_committee disp_funds_charity disp_funds_95 candidate_position policy_position party_affiliation purpose",
    "Candidates": "id last_name first_name address1 address2 city state zipcode office district_type district residence_county party_affiliation redaction_requested",
    "Receipts": "id committee_id filed_doc_id etrans_id last_name first_name received_date amount aggregate_amount loan_amount occupation employer address1 address2 city state zipcode d2_part description vendor_last_name vendor_first_name vendor_address1 vendor_address2 vendor_city vendor_state vendor_zipcode archived country redaction_requested",
    "Expenditures": "id committee_id filed_doc_id etrans_id last_name first_name expended_date amount aggregate_amount address1 address2 city state zipcode d2_part purpose candidate_name office supporting opposing archived country redaction_requested",
    "D2Totals": "id committee_id filed_doc_id beginning_funds_avail individual_itemized individual_non_itemized transfer_in loan_received other_receipts total_receipts inkind_itemized inkind_non_itemized total_inkind expenditures_itemized expenditures_non_itemized independent_expenditures_itemized independent_expenditures_non_itemized total_expenditures debts_itemized debts_non_itemized total_debts total_investments end_funds_available archived",
    "CmteCandidateLinks": "id committee_id candidate_id",
    "FiledDocs": "id committee_id filed_doc_type doc_name amended comment pages election_type election_year reporting_period_begin reporting_period_end received_at received_datetime source provider signer_last_name signer_first_name submitter_last_name submitter_first_name submitter_address1 submitter_address2 submitter_city submitter_state submitter_zipcode b9_signer_last_name b9_signer_first_name archived clarification redaction_requested",
    "CanElections": "id candidate_id election_type election_year inc_chall_open won_lost fair_campaign limits_off limits_off_reason",
    "Officers": "id last_name first_name address1 address2 city state zipcode title phone redaction_requested",
    "PrevOfficers": "id committee_id last_name first_name address1 address2 city state zipcode title resign_date redaction_requested",
    "CmteOfficerLinks": "id committee_id officer_id",
    "Investments": "id committee_id filed_doc_id description purchase_date purchase_shares purchase_price current_value liquid_value liquid_date last_name first_name address1 address2 city state zipcode",
}
_MONEY = ("amount", "funds", "itemized", "transfer_in", "received", "receipts", "inkind", "expenditures", "debts", "investments", "price", "value", "shares")
_FLAGS = {"state_committee", "local_committee", "archived", "redaction_requested", "amended", "supporting", "opposing", "disp_funds_return", "disp_funds_political_committee", "disp_funds_charity", "disp_funds_95", "fair_campaign", "limits_off"}
_DATES = {"reporting_period_begin", "reporting_period_end", "received_datetime"}


def kinds(feed: str) -> dict[str, str]:
    """Kind of each column that isn't text: ids and years are whole numbers, `_date` columns dates, sums money, flags true or false."""
    out = {}
    for c in LAYOUTS[feed].split():
        if c == "id" or c.endswith("_id") and c != "etrans_id" or c in ("election_year", "pages"):
            out[c] = "int"
        elif c in _FLAGS:
            out[c] = "bool"
        elif c.endswith("_date") or c in _DATES:
            out[c] = "date"
        elif c != "received_at" and any(m in c for m in _MONEY):
            out[c] = "money"
    return out


def load_feed(spark: SparkSession, path: str, feed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a tab-delimited file with a header: columns by position, typed; missing flags are false; rows without an id are rejected.

    Bad values become null, short rows are filled with nulls, fields beyond the layout are ignored.
    """
    names = LAYOUTS[feed].split()
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in names), quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    own = kinds(feed)
    rows = typed(raw, {c: own.get(c, "text") for c in names})
    rows = rows.select(*[F.coalesce(F.col(c), F.lit(False)).alias(c) if own.get(c) == "bool" else F.col(c) for c in names])
    return split_rejects(rows, [("missing_id", F.col("id").isNull())])


def attach_officer_committees(current: DataFrame, previous: DataFrame, links: DataFrame) -> DataFrame:
    """Current and previous officers as one table; current ones get their committees from the links, one row each."""
    both = [c for c in current.columns if c in previous.columns]
    found = current.join(links.select(F.col("officer_id").alias("id"), F.col("committee_id").alias("committee_id")), "id", "left")
    return found.select(*both, "committee_id", F.lit(None).cast("date").alias("resign_date"), F.lit(True).alias("is_current")).unionByName(previous.select(*both, "committee_id", "resign_date", F.lit(False).alias("is_current")))
