"""Column lists, word lists, dimension rows and search grids.

Everything in this module must equal the values the data model is defined with.
"""

# --- fixed values: columns ---------------------------------------------------------------

SCOPE1 = "scope1_emissions"
SCOPE2 = "scope2_emissions"
TARGETS = [SCOPE1, SCOPE2]
KEYS = ["company_name", "reporting_year"]
REQUIRED = ["company_name", "reporting_year", SCOPE1, SCOPE2]
NUMERIC = ["revenue", "total_assets", "market_cap", "employee_count"]
CATEGORICAL = ["sector", "industry", "country"]
MACRO = ["gdp_per_capita", "energy_intensity"]
LOG_OF = {
    "revenue": "log_revenue",
    "total_assets": "log_assets",
    "employee_count": "log_employees",
    "market_cap": "log_market_cap",
}
RATIO_OF = {
    "asset_per_employee": ("total_assets", "employee_count"),
    "revenue_per_employee": ("revenue", "employee_count"),
    "asset_to_revenue": ("total_assets", "revenue"),
    "employee_density": ("employee_count", "total_assets"),
    "market_cap_to_revenue": ("market_cap", "revenue"),
    "capital_intensity": ("total_assets", "revenue"),
}
GROUP_MEANS = [
    "sector_mean_log_scope1",
    "sector_mean_log_scope2",
    "country_mean_log_scope1",
    "country_mean_log_scope2",
]
CODES = ["sector_encoded", "industry_encoded", "country_encoded"]
FEATURES = list(LOG_OF.values()) + list(RATIO_OF) + MACRO + GROUP_MEANS + CODES
FLAGGED = NUMERIC + TARGETS
FLAGS = [f"{c}_missing" for c in FLAGGED]

# --- fixed values: indicator codes -------------------------------------------------------

INDICATORS = {
    "NY.GDP.PCAP.CD": "gdp_per_capita",
    "EG.USE.PCAP.KG.OE": "energy_intensity",
}

# --- fixed values: legal-form and filler words dropped from company names ----------------

COMPANY_SUFFIX = (
    r"\b(inc\.?|ltd\.?|corp\.?|plc\.?|co\.?|llc|sa|ag|nv|se|group|holdings|international|global|solutions|systems|partners|industries)\b"
)

# --- fixed values: sector profile --------------------------------------------------------
# mean and sigma of the logs of revenue, assets and employees, tonnes per million of revenue
# for scope 1 and scope 2, mean and sigma of the log of market cap

SECTOR_PROFILE = {
    "Energy": {
        "rev_mu": 9.5, "rev_sig": 1.2,
        "ast_mu": 10.0, "ast_sig": 1.1,
        "emp_mu": 9.0, "emp_sig": 0.9,
        "s1_factor": 850.0, "s2_factor": 120.0,
        "mcap_mu": 10.0, "mcap_sig": 1.3,
    },
    "Materials": {
        "rev_mu": 8.8, "rev_sig": 1.1,
        "ast_mu": 9.3, "ast_sig": 1.0,
        "emp_mu": 8.5, "emp_sig": 0.8,
        "s1_factor": 600.0, "s2_factor": 180.0,
        "mcap_mu": 9.2, "mcap_sig": 1.2,
    },
    "Industrials": {
        "rev_mu": 8.5, "rev_sig": 1.0,
        "ast_mu": 9.0, "ast_sig": 1.0,
        "emp_mu": 9.2, "emp_sig": 0.9,
        "s1_factor": 200.0, "s2_factor": 100.0,
        "mcap_mu": 9.0, "mcap_sig": 1.1,
    },
    "Consumer Discretionary": {
        "rev_mu": 8.3, "rev_sig": 1.1,
        "ast_mu": 8.8, "ast_sig": 1.0,
        "emp_mu": 9.5, "emp_sig": 1.0,
        "s1_factor": 50.0, "s2_factor": 80.0,
        "mcap_mu": 9.0, "mcap_sig": 1.2,
    },
    "Consumer Staples": {
        "rev_mu": 8.8, "rev_sig": 1.0,
        "ast_mu": 9.0, "ast_sig": 0.9,
        "emp_mu": 9.6, "emp_sig": 0.8,
        "s1_factor": 80.0, "s2_factor": 60.0,
        "mcap_mu": 9.3, "mcap_sig": 1.0,
    },
    "Health Care": {
        "rev_mu": 8.5, "rev_sig": 1.2,
        "ast_mu": 9.0, "ast_sig": 1.1,
        "emp_mu": 9.3, "emp_sig": 1.0,
        "s1_factor": 30.0, "s2_factor": 50.0,
        "mcap_mu": 9.5, "mcap_sig": 1.3,
    },
    "Financials": {
        "rev_mu": 8.8, "rev_sig": 1.3,
        "ast_mu": 11.0, "ast_sig": 1.5,
        "emp_mu": 9.5, "emp_sig": 1.0,
        "s1_factor": 5.0, "s2_factor": 30.0,
        "mcap_mu": 10.0, "mcap_sig": 1.4,
    },
    "Information Technology": {
        "rev_mu": 8.5, "rev_sig": 1.3,
        "ast_mu": 9.0, "ast_sig": 1.2,
        "emp_mu": 9.0, "emp_sig": 1.1,
        "s1_factor": 10.0, "s2_factor": 60.0,
        "mcap_mu": 9.8, "mcap_sig": 1.5,
    },
    "Communication Services": {
        "rev_mu": 8.5, "rev_sig": 1.2,
        "ast_mu": 9.2, "ast_sig": 1.1,
        "emp_mu": 9.0, "emp_sig": 0.9,
        "s1_factor": 15.0, "s2_factor": 55.0,
        "mcap_mu": 9.5, "mcap_sig": 1.3,
    },
    "Utilities": {
        "rev_mu": 8.5, "rev_sig": 0.9,
        "ast_mu": 9.8, "ast_sig": 0.8,
        "emp_mu": 8.5, "emp_sig": 0.7,
        "s1_factor": 1200.0, "s2_factor": 50.0,
        "mcap_mu": 9.3, "mcap_sig": 0.9,
    },
    "Real Estate": {
        "rev_mu": 7.8, "rev_sig": 1.0,
        "ast_mu": 9.5, "ast_sig": 1.0,
        "emp_mu": 7.5, "emp_sig": 0.8,
        "s1_factor": 20.0, "s2_factor": 70.0,
        "mcap_mu": 9.0, "mcap_sig": 1.1,
    },
}
SECTORS = list(SECTOR_PROFILE)

# --- fixed values: industries per sector -------------------------------------------------

INDUSTRIES = {
    "Energy": ["Oil & Gas Exploration", "Oil & Gas Refining", "Renewable Energy", "Coal Mining"],
    "Materials": ["Chemicals", "Steel & Metals", "Paper & Forestry", "Construction Materials"],
    "Industrials": ["Aerospace & Defence", "Machinery", "Transportation", "Building Products"],
    "Consumer Discretionary": ["Automobiles", "Retail", "Textiles & Apparel", "Hotels & Leisure"],
    "Consumer Staples": ["Food & Beverages", "Household Products", "Tobacco", "Personal Care"],
    "Health Care": ["Pharmaceuticals", "Biotechnology", "Medical Devices", "Healthcare Services"],
    "Financials": ["Banks", "Insurance", "Asset Management", "Diversified Financial Services"],
    "Information Technology": ["Software", "Hardware", "Semiconductors", "IT Services"],
    "Communication Services": [
        "Telecommunications", "Media & Entertainment", "Internet Services", "Advertising",
    ],
    "Utilities": ["Electric Utilities", "Gas Utilities", "Water Utilities", "Multi-Utilities"],
    "Real Estate": [
        "REITs", "Real Estate Development", "Property Management", "Real Estate Services",
    ],
}

# --- fixed values: country code, GDP per head, energy use --------------------------------

COUNTRIES = [
    ("USA", 76330.0, 4.58),
    ("GBR", 46510.0, 2.88),
    ("DEU", 51380.0, 3.31),
    ("FRA", 43520.0, 3.58),
    ("JPN", 39290.0, 3.41),
    ("CHN", 12720.0, 8.91),
    ("IND", 2410.0, 4.73),
    ("BRA", 8920.0, 3.89),
    ("CAN", 52960.0, 6.81),
    ("AUS", 64490.0, 5.32),
    ("KOR", 34990.0, 5.01),
    ("ZAF", 6010.0, 7.22),
    ("MEX", 10820.0, 3.41),
    ("NOR", 82830.0, 4.91),
    ("SAU", 27610.0, 6.52),
]

# ISO 3166 numeric codes and formal names of the countries above; the two-letter codes and
# English names of all countries come from the Java locale data (sources/dimensions.py)
COUNTRY_FORMAL = [
    ("840", "United States of America", "USA"),
    ("826", "United Kingdom of Great Britain and Northern Ireland", "GBR"),
    ("276", "Federal Republic of Germany", "DEU"),
    ("250", "French Republic", "FRA"),
    ("392", "Japan", "JPN"),
    ("156", "People's Republic of China", "CHN"),
    ("356", "Republic of India", "IND"),
    ("076", "Federative Republic of Brazil", "BRA"),
    ("124", "Canada", "CAN"),
    ("036", "Australia", "AUS"),
    ("410", "Korea, Republic of", "KOR"),
    ("710", "Republic of South Africa", "ZAF"),
    ("484", "United Mexican States", "MEX"),
    ("578", "Kingdom of Norway", "NOR"),
    ("682", "Kingdom of Saudi Arabia", "SAU"),
]

# --- fixed values: scoring defaults ------------------------------------------------------

DEFAULT_GDP = 50000.0
DEFAULT_ENERGY = 4.5
DEFAULT_FACTOR = 100.0
DEFAULT_COUNTRY_MEAN = {"scope1": 10.0, "scope2": 9.0}
DEFAULT_R2 = 0.5
MIN_SPREAD = 0.1

# --- fixed values: split, search and sample sizes ----------------------------------------

SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
SEARCH_DRAWS = 30
SMOKE_DRAWS = 5
EXPLAIN_ROWS = 200
BACKGROUND_ROWS = 50
PAIR_ROWS = 300
MI_MIN_ROWS = 20
SECTOR_MIN_ROWS = 5

# --- fixed values: search grids, in MLlib parameter names --------------------------------
# an unbounded depth is MLlib's largest one (30); a leaf budget L bounds depth by log2(L)

GRIDS = {
    "RandomForest": {
        "numTrees": [100, 200, 400, 600],
        "maxDepth": [6, 10, 15, 20, 30],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "0.5"],
    },
    "GradientBoosting": {
        "maxIter": [100, 200, 400],
        "maxDepth": [3, 5, 7, 10],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
        "minInstancesPerNode": [1, 2, 4],
    },
    "HistogramBoosting": {
        "maxIter": [100, 200, 400, 600],
        "maxDepth": [3, 5, 7, 10],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
        "columnShare": [0.6, 0.8, 1.0],
        "alpha": [0.0, 0.1, 1.0],
        "lambda_": [1.0, 2.0, 5.0],
    },
    "OrderedBoosting": {
        "maxIter": [200, 400, 600],
        "maxDepth": [4, 6, 8, 10],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "lambda_": [1.0, 3.0, 5.0, 7.0],
        "baggingTemperature": [0.0, 0.5, 1.0],
    },
    "LeafwiseBoosting": {
        "maxIter": [100, 200, 400, 600],
        "maxDepth": [3, 5, 7, 10, -1],
        "stepSize": [0.01, 0.05, 0.1, 0.2],
        "numLeaves": [15, 31, 63, 127],
        "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
        "columnShare": [0.6, 0.8, 1.0],
        "alpha": [0.0, 0.1, 1.0],
        "lambda_": [1.0, 2.0, 5.0],
    },
}
