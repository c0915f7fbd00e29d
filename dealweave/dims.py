"""Small reference tables: field schemas, aliases, classification keywords. All are parameters of the operators that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fields of document types: (name, required), in order.
FIELD_SCHEMA: dict[str, list[tuple[str, bool]]] = {
    "income_statement": [("revenue", True), ("cogs", True), ("grossProfit", True), ("ebitda", True), ("netIncome", True), ("grossMargin", False), ("operatingExpenses", False), ("ebitdaMargin", False), ("depreciation", False), ("amortization", False), ("interestExpense", False), ("netMargin", False), ("sga", False)],
    "balance_sheet": [("cash", True), ("accountsReceivable", True), ("totalCurrentAssets", True), ("totalAssets", True), ("accountsPayable", True), ("totalCurrentLiabilities", True), ("longTermDebt", True), ("totalLiabilities", True), ("equity", True), ("inventory", False), ("ppe", False), ("currentPortionLTD", False), ("goodwill", False), ("intangibles", False)],
    "cash_flow_statement": [("operatingCashFlow", True), ("capex", True), ("freeCashFlow", True), ("investingCashFlow", False), ("financingCashFlow", False), ("netChangeInCash", False), ("dividendsPaid", False), ("debtRepayment", False)],
    "tax_return": [("taxableIncome", True), ("totalTaxLiability", True), ("filingYear", True), ("effectiveTaxRate", False), ("entityType", False), ("grossReceipts", False), ("officerCompensation", False)],
    "debt_schedule": [("totalDebt", True), ("instruments", True), ("weightedAvgRate", False), ("annualDebtService", False), ("nearestMaturity", False)],
    "qoe_report": [("adjustedEbitda", True), ("totalAddBacks", True), ("addBacks", False), ("ownerCompensation", False), ("normalizedOwnerComp", False), ("workingCapitalTarget", False), ("reportedEbitda", False)],
    "projections": [("projectedRevenue", True), ("projectedEbitda", True), ("projectedGrowthRate", False), ("projectedMargin", False), ("assumptions", False)],
    "ar_aging": [("totalAR", True), ("current", True), ("days30", False), ("days60", False), ("days90", False), ("days90Plus", False), ("concentrationTopCustomer", False), ("concentrationTop5", False)],
    "ap_aging": [("totalAP", True), ("current", True), ("days30", False), ("days60", False), ("days90", False), ("days90Plus", False)],
    "revenue_breakdown": [("totalRevenue", True), ("customers", True), ("topCustomerPct", False), ("top3Pct", False), ("top5Pct", False), ("customerCount", False)],
}

#: Wordings of the balance sheet's fields, in order of preference.
BALANCE_SHEET_ALIASES: dict[str, list[str]] = {
    "cash": ["cash", "cash and equivalents", "cash & equivalents"],
    "accountsReceivable": ["accounts receivable", "trade receivables", "a/r"],
    "inventory": ["inventory"],
    "totalCurrentAssets": ["total current assets", "current assets"],
    "ppe": ["ppe", "property plant and equipment", "property, plant and equipment", "net pp&e", "net ppe", "net pp and e"],
    "totalAssets": ["total assets"],
    "accountsPayable": ["accounts payable", "a/p", "trade payables"],
    "currentPortionLTD": ["current portion of ltd", "current portion of lt debt", "current portion of long term debt", "current maturities of debt"],
    "totalCurrentLiabilities": ["total current liabilities", "current liabilities"],
    "longTermDebt": ["long term debt", "long-term debt", "lt debt", "total long term liabilities", "total long-term liabilities"],
    "totalLiabilities": ["total liabilities"],
    "equity": ["equity", "shareholders equity", "stockholders equity", "total equity"],
    "goodwill": ["goodwill"],
    "intangibles": ["intangibles", "intangible assets"],
}

#: Wordings of the fields of the other document types, in order of preference.
OTHER_ALIASES: dict[str, dict[str, list[str]]] = {
    "income_statement": {
        "revenue": ["revenue", "net sales", "total sales", "sales"],
        "cogs": ["cogs", "cost of goods sold", "cost of revenue", "cost of sales"],
        "grossProfit": ["gross profit", "gross margin dollars"],
        "operatingExpenses": ["operating expenses", "opex", "total operating expenses", "total op ex", "total opex", "other op ex", "other opex"],
        "ebitda": ["ebitda", "adjusted ebitda"],
        "depreciation": ["depreciation", "depreciation expense"],
        "amortization": ["amortization", "amortization expense"],
        "interestExpense": ["interest expense", "interest"],
        "netIncome": ["net income", "net earnings", "profit after tax"],
        "sga": ["sg&a", "sga", "selling general administrative", "selling general and administrative"],
        "__operatingProfit": ["operating profit", "operating income", "ebit"],
        "__daCombined": ["d&a", "depreciation & amortization", "depreciation and amortization"],
    },
    "cash_flow_statement": {
        "operatingCashFlow": ["operating cash flow", "cash from operations", "net cash provided by operating activities"],
        "capex": ["capex", "capital expenditures", "capital expenditure"],
        "investingCashFlow": ["investing cash flow", "net cash used in investing activities"],
        "financingCashFlow": ["financing cash flow", "net cash from financing activities"],
        "netChangeInCash": ["net change in cash", "change in cash"],
        "dividendsPaid": ["dividends paid", "dividends"],
        "debtRepayment": ["debt repayment", "repayment of debt", "debt paydown"],
    },
    "ar_aging": {
        "totalAR": ["total ar", "accounts receivable", "total receivables"],
        "current": ["current", "0-30", "0 30", "0 to 30"],
        "days30": ["31-60", "30-60", "1-30", "1 to 30"],
        "days60": ["61-90", "60-90", "31-60 days", "31 to 60"],
        "days90": ["91-120", "90-120", "61-90 days", "61 to 90"],
        "days90Plus": ["120+", "90+", "over 90", "over 120", "120 plus", "90 plus"],
        "concentrationTopCustomer": ["top customer %", "top customer concentration"],
        "concentrationTop5": ["top 5 %", "top 5 concentration"],
    },
    "ap_aging": {
        "totalAP": ["total ap", "accounts payable", "total payables"],
        "current": ["current", "0-30", "0 30", "0 to 30"],
        "days30": ["31-60", "30-60", "1-30", "1 to 30"],
        "days60": ["61-90", "60-90", "31-60 days", "31 to 60"],
        "days90": ["91-120", "90-120", "61-90 days", "61 to 90"],
        "days90Plus": ["120+", "90+", "over 90", "over 120", "120 plus", "90 plus"],
    },
    "debt_schedule": {
        "totalDebt": ["total debt", "outstanding debt"],
        "annualDebtService": ["annual debt service", "debt service"],
        "weightedAvgRate": ["weighted average rate", "weighted avg rate"],
        "nearestMaturity": ["nearest maturity", "next maturity"],
    },
    "revenue_breakdown": {
        "totalRevenue": ["total revenue", "total sales"],
        "topCustomerPct": ["top customer %", "top customer pct"],
        "top3Pct": ["top 3 %", "top 3 pct"],
        "top5Pct": ["top 5 %", "top 5 pct"],
        "customerCount": ["customer count", "number of customers"],
    },
    "projections": {
        "projectedRevenue": ["projected revenue", "forecast revenue", "revenue"],
        "projectedEbitda": ["projected ebitda", "forecast ebitda", "ebitda"],
        "projectedGrowthRate": ["growth rate", "projected growth rate", "revenue growth"],
        "projectedMargin": ["projected margin", "ebitda margin", "margin"],
    },
    "tax_return": {
        "taxableIncome": ["taxable income"],
        "totalTaxLiability": ["total tax liability", "tax liability"],
        "filingYear": ["filing year", "tax year"],
        "effectiveTaxRate": ["effective tax rate"],
        "entityType": ["entity type"],
        "grossReceipts": ["gross receipts", "gross revenue"],
        "officerCompensation": ["officer compensation"],
    },
    "qoe_report": {
        "adjustedEbitda": ["adjusted ebitda"],
        "totalAddBacks": ["total add backs", "total add-backs", "total adjustments"],
        "ownerCompensation": ["owner compensation", "officer compensation"],
        "normalizedOwnerComp": ["normalized owner comp", "market owner compensation"],
        "workingCapitalTarget": ["working capital target"],
        "reportedEbitda": ["reported ebitda", "ebitda"],
    },
}

#: Wordings of the columns of tables with one row per instrument or customer, by role.
COLUMN_ALIASES: dict[str, dict[str, list[str]]] = {
    "debt_schedule": {
        "instrument": ["instrument", "loan", "facility", "debt instrument"],
        "principal": ["principal", "balance", "outstanding", "amount"],
        "interestRate": ["interest rate", "rate", "coupon"],
        "maturityDate": ["maturity", "maturity date"],
        "annualDebtService": ["annual debt service", "debt service", "annual p&i", "annual p and i", "p&i"],
    },
    "revenue_breakdown": {
        "name": ["customer", "customer name", "account", "name", "service line", "segment"],
        "revenue": ["revenue", "sales", "net sales"],
        "percentage": ["percentage", "% of revenue", "% mix", "mix", "share", "concentration"],
    },
}

#: Words in titles and headers that tell a document type.
TYPE_KEYWORDS: dict[str, list[str]] = {
    "balance_sheet": ["balance sheet", "statement of financial position", "assets and liabilities"],
    "debt_schedule": ["debt schedule", "loan schedule", "debt summary", "outstanding debt", "credit facility", "note payable"],
    "revenue_breakdown": ["revenue breakdown", "customer concentration", "customer list", "revenue by customer", "sales by customer", "customer revenue", "top customers"],
    "ar_aging": ["ar aging", "a/r aging", "accounts receivable aging", "receivable aging", "receivables aging"],
}


def schema_table(spark: SparkSession) -> DataFrame:
    """``doc_type, field_name, required, ordinal``."""
    rows = [(t, f, r, i + 1) for t, fields in FIELD_SCHEMA.items() for i, (f, r) in enumerate(fields)]
    return spark.createDataFrame(rows, "doc_type string, field_name string, required boolean, ordinal int")


def all_aliases_table(spark: SparkSession) -> DataFrame:
    """``doc_type, field_name, alias, ordinal`` of all document types."""
    types = {"balance_sheet": BALANCE_SHEET_ALIASES} | OTHER_ALIASES
    rows = [(t, f, a, i + 1) for t, fields in types.items() for i, (f, a) in enumerate((f, a) for f, names in fields.items() for a in names)]
    return spark.createDataFrame(rows, "doc_type string, field_name string, alias string, ordinal int")


def aliases_table(spark: SparkSession, doc_type: str = "balance_sheet", aliases: dict[str, list[str]] = BALANCE_SHEET_ALIASES) -> DataFrame:
    """``doc_type, field_name, alias, ordinal``."""
    rows = [(f, a) for f, names in aliases.items() for a in names]
    return spark.createDataFrame([(doc_type, f, a, i + 1) for i, (f, a) in enumerate(rows)], "doc_type string, field_name string, alias string, ordinal int")

