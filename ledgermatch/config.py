"""Domains and fixed labels of the reconciliation rules.

Everything here is a value that must stay exactly as written for results to
agree with the ledger review rules (labels are user-visible output).
"""

# --- fixed values: business domains -------------------------------------
COUNTRIES = ("Kenya", "Rwanda")

STATUSES = (
    "matched",
    "no_swap_in_loaded_data",
    "no_successful_swap_in_loaded_data",
    "missing_wallet_transaction_id",
    "ambiguous_transaction_id",
    "missing_amount",
    "amount_mismatch",
)

# Eligible wallet debit: committed debit settled against a swap.
DEBIT_TYPE = "Debit"
COMMITTED = "Committed"
SETTLED_SWAP = "Swap"
# Successful swap record.
SWAP_SUCCESS = "SUCCESS"
WALLET_METHOD = "WALLET"

# Review-side labels.
MISSING_TX = "missing_wallet_transaction_id"
AMBIGUOUS = "ambiguous_transaction_id"
NO_SWAP = "no_swap_in_loaded_data"
NO_SUCCESS = "no_successful_swap_in_loaded_data"
MISSING_AMOUNT = "missing_amount"
AMOUNT_MISMATCH = "amount_mismatch"
MATCHED = "matched"

WALLET_NOT_LOADED = "wallet_not_loaded"
CUSTOMER_NOT_AVAILABLE = "customer_not_available"
MAPPED = "mapped"

WALLET_LOOKUP_UNAVAILABLE = "wallet_customer_lookup_unavailable"
SWAP_LOOKUP_UNAVAILABLE = "swap_customer_lookup_unavailable"
LOOKUP_AGREES = "agrees"
LOOKUP_DIFFERS = "differs"

PAYMENT_REVIEW = "payment_method_needs_review"
LOOKUP_DIFFERS_REASON = "customer_lookup_differs"
LOOKUP_UNAVAILABLE_REASON = "customer_lookup_unavailable"
CURRENCY_UNAVAILABLE = "currency_unavailable"
COUNTRY_UNAVAILABLE = "country_unavailable"
TIMESTAMP_UNAVAILABLE = "timestamp_unavailable"

NO_SWAP_DATA = "no_swap_data_loaded"
BEFORE_SWAP_START = "before_observed_swap_start"
AFTER_SWAP_CUTOFF = "after_observed_swap_cutoff"
WITHIN_SWAP_SPAN = "within_observed_swap_span"

NOT_VERIFIED = "not_verified"

# Counterpart (gap) report labels.
GAP_MISSING_TX = "missing_transaction_id"
GAP_MISSING_COUNTRY = "missing_country"
GAP_NO_SWAP = "no_swap_in_loaded_data"
GAP_NO_DEBIT = "no_committed_swap_wallet_debit_in_loaded_data"
NO_COUNTERPART_DATA = "no_counterpart_data_loaded"
BEFORE_COUNTERPART = "before_observed_counterpart_start"
AFTER_COUNTERPART = "after_observed_counterpart_end"
WITHIN_COUNTERPART = "within_observed_counterpart_span"

# Four counterpart tracking groups: group -> (side, identifier class).
TRACKING_GROUPS = {
    "wallet_without_swap": ("wallet_without_swap", "valid"),
    "swap_without_wallet": ("swap_without_wallet", "valid"),
    "unmatchable_swaps": ("swap_without_wallet", "unmatchable"),
    "unmatchable_wallets": ("wallet_without_swap", "unmatchable"),
}
UNKNOWN_COUNTRY = "Unknown"
WALLET_RECORD_TYPE = "Wallet deduction"
SWAP_RECORD_TYPE = "Swap"

# Limits.
MAX_PAGE = 1000
MAX_TRACKING_PAGE = 100
MAX_EXPORT = 10000
EXPORT_CAP_WARNING_ROWS = 200000

# Spreadsheet formula prefixes that get a protective leading quote.
FORMULA_PREFIXES = ("=", "+", "-", "@", "\t", "\r")
# --- end of fixed values ------------------------------------------------
