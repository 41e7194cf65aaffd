"""Closed vocabularies. All of these are fixed values that results depend on."""

from __future__ import annotations

# Spending categories, each owned by the calculator it starts with.
SPENDING_LABELS = [
    "HOUSING_RENT_OR_MORTGAGE",
    "HOUSING_UTILITIES",
    "HOUSING_INTERNET",
    "HOUSING_PARKING_RESIDENTIAL",
    "HEALTH_PREMIUM",
    "HEALTH_OUT_OF_POCKET",
    "COMMUTE_TRANSIT_FARE",
    "COMMUTE_FUEL",
    "COMMUTE_TOLLS",
    "COMMUTE_PARKING_WORK",
    "COMMUTE_VEHICLE_WEAR",
    "LIVING_GROCERY",
    "LIVING_DINING",
    "LIVING_PHONE",
    "LIVING_VEHICLE_FIXED",
    "LIVING_GYM",
    "LIVING_SUBSCRIPTIONS",
    "LIVING_ENTERTAINMENT",
    "LIVING_TRAVEL",
    "LIVING_OTHER",
    "LIVING_CLOTHING",
    "LIVING_EDUCATION",
    "LIVING_INSURANCE",
    "LIVING_CARD_FEE",
    "RELOCATION_MOVE",
    "RELOCATION_DEPOSIT",
    "RELOCATION_BROKER_FEE",
    "RELOCATION_LEASE_BREAK",
    "RELOCATION_FURNISHING",
]
OWNERS = ["HOUSING", "HEALTH", "COMMUTE", "LIVING", "RELOCATION"]
UNKNOWN = "UNKNOWN"
LABEL_SPACE = [*SPENDING_LABELS, "INCOME", "TRANSFER", "REFUND", UNKNOWN]

# The five branches of a monthly report, in order.
BRANCHES = ["income", "spending", "refunds", "transfers", "unclassified"]

# Provenance ranks, weakest first.
EVIDENCE = {"ASSUMED": 0, "DERIVED": 1, "USER_CONFIRMED": 2, "SOURCED": 3}

# Cadence name, nominal days, charges per year.
CADENCES = [
    ("WEEKLY", 7, 52),
    ("FORTNIGHTLY", 14, 26),
    ("MONTHLY", 30, 12),
    ("QUARTERLY", 91, 4),
    ("ANNUAL", 365, 1),
]

# Header aliases per field; order is preference.
HEADER_ALIASES = {
    "date": [
        "date", "transaction date", "trans date", "posted date", "post date",
        "posting date", "date posted", "value date", "completed date",
    ],
    "description": [
        "description", "details", "memo", "narrative", "transaction",
        "particulars", "reference", "notes",
    ],
    "merchant": ["merchant", "payee", "vendor", "name", "counterparty", "beneficiary"],
    "amount": ["amount", "value", "transaction amount", "amt"],
    "debit": [
        "debit", "debits", "withdrawal", "withdrawals", "money out", "paid out",
        "charge", "charges", "outflow",
    ],
    "credit": [
        "credit", "credits", "deposit", "deposits", "money in", "paid in", "inflow",
    ],
}

# Words that mark movement between own accounts.
TRANSFER_WORDS = ["TRANSFER", "XFER", "TFR TO", "TFR FROM", "ZELLE"]

# Review policy.
POLICY_ID = "POL-PROC-04"
POLICY_THRESHOLD = "3000.00"
POLICY_TERMS = ["receipt", "review", "purchase", "duplicate", "policy"]
