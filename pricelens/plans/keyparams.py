"""Parameters of the registered queries, shared by the Spark and SQL sides.

They are the arguments a user would pass (a search term, a clock, a
retention window), fixed here so both engines answer the same question.
"""

from datetime import datetime

from pricelens.params import BLACKLIST_TERMS

# Part names are generic; two of their words act as accessory terms so the
# relevance filter has something to drop on the catalog searches.
CATALOG_TERMS = BLACKLIST_TERMS + ("anvil", "plate")
CATALOG_MIN_PRICE = 950
POSTS_MIN_PRICE = 500

# "now" for freshness and retention: just after the last event of the data.
NOW = datetime(2024, 1, 31, 0, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
CACHE_TTL_HOURS = 6.0
RETENTION_DAYS = 7

CANDIDATE_LIMIT = 5
SCAN_PAGES = 3
DEALS_LIMIT = 10
DROPS_LIMIT = 10
EXPORT_QUERY = "view"          # the search exported / listed by query
# Allowed hosts for the captured pages' own links (their sites are example.*).
PAGE_HOSTS_EXACT = ("example.com",)
PAGE_HOST_SUFFIXES = (".example.com", ".example.org")

# The event values behind observation prices run from 0 to a few hundred, so
# the scan flow's minimum price is set in that range.
OBS_MIN_PRICE = 10
