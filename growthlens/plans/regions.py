"""Fixed values shared by the jobs."""

# Names as they stand in the published statistics.
REGIONS = [
    "Canada",
    "Quebec",
    "Ontario",
    "British Columbia",
    "Alberta",
    "Manitoba",
    "New Brunswick",
    "Newfoundland and Labrador",
    "Nova Scotia",
    "Saskatchewan",
    "Prince Edward Island",
]

# Region part of the household file names.
HOUSEHOLD_ALIASES = {
    "Alberta": "Alberta",
    "BC": "British Columbia",
    "Manitoba": "Manitoba",
    "NewBrunswick": "New Brunswick",
    "NewFoundland": "Newfoundland and Labrador",
    "NoviaScotia": "Nova Scotia",
    "NovaScotia": "Nova Scotia",
    "Ontario": "Ontario",
    "PEI": "Prince Edward Island",
    "quebec": "Quebec",
    "Saskachewan": "Saskatchewan",
    "Saskatchewan": "Saskatchewan",
    "Canada": "Canada",
}

# Age groups that do not overlap.
AGE_CATEGORIES = {
    "0 to 14 years": "Children (0–14)",
    "15 to 64 years": "Working Age (15–64)",
    "90 years and older": "Elderly (90+)",
    "All ages": "All Ages",
}

FLOW_COLUMNS = ["Total PRs", "Total TRs", "Total Births", "Total Deaths"]
