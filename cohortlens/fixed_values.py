"""Values that define the analyses: item ids, code texts, bands and word lists.

Nothing here is tuned. Every operator takes these as parameters, so another
data set with other codes passes its own.
"""

# Item ids of charted measurements.
HEART_RATE_ITEMS = (220045, 211, 5972)
ERA_ITEMS = (211, 220045)
PROXY_ITEM = 220045
WHITE_CELL_ITEMS = (51300, 51301)
CODE_STATUS_ITEMS = (128, 223758)

# Bands and thresholds.
WHITE_CELL_BAND = (4.5, 11.0)
HEART_RATE_RANGE = (0.0, 250.0)
ERA_RANGE = (0.0, 300.0)
PROXY_RANGE = (0.0, 100.0)
HEART_RATE_BIN_WIDTH = 3.0
HEART_RATE_BINS = 86
ORDER_TOLERANCES = (10, 360)
DELTA_BINS = 30
ERA_BINS = 50

# Cohort exclusions.
END_OF_LIFE_CODES = ("V667",)
HOSPICE_OR_DEATH = ("HOSPICE-HOME", "HOSPICE-MEDICAL FACILITY", "DEAD/EXPIRED")

# Charted texts behind each care-status flag, and the order in
# which the flags decide the single status of a stay.
CODE_STATUS_TEXTS = {
    "fullcode": ("Full Code", "Full code"),
    "cmo": ("Comfort Measures", "Comfort measures only"),
    "dnr": ("Do Not Resuscita", "DNR (do not resuscitate)", "DNR / DNI"),
    "dni": ("Do Not Intubate", "DNI (do not intubate)", "DNR / DNI"),
    "dncpr": ("CPR Not Indicate",),
}
CODE_STATUS_IGNORED_TEXTS = ("Other/Remarks",)
CODE_STATUS_PRIORITY = ("fullcode", "cmo", "dnr", "dni", "dncpr")

# Exact ethnicity entries of each group; the rest are 'other'.
ETHNICITY_GROUPS = {
    "white": (
        "WHITE",
        "WHITE - RUSSIAN",
        "WHITE - OTHER EUROPEAN",
        "WHITE - BRAZILIAN",
        "WHITE - EASTERN EUROPEAN",
    ),
    "black": (
        "BLACK/AFRICAN AMERICAN",
        "BLACK/CAPE VERDEAN",
        "BLACK/HAITIAN",
        "BLACK/AFRICAN",
        "CARIBBEAN ISLAND",
    ),
    "hispanic": (
        "HISPANIC OR LATINO",
        "HISPANIC/LATINO - PUERTO RICAN",
        "HISPANIC/LATINO - DOMINICAN",
        "HISPANIC/LATINO - GUATEMALAN",
        "HISPANIC/LATINO - CUBAN",
        "HISPANIC/LATINO - SALVADORAN",
        "HISPANIC/LATINO - CENTRAL AMERICAN (OTHER)",
        "HISPANIC/LATINO - MEXICAN",
        "HISPANIC/LATINO - COLOMBIAN",
        "HISPANIC/LATINO - HONDURAN",
    ),
    "asian": (
        "ASIAN",
        "ASIAN - CHINESE",
        "ASIAN - ASIAN INDIAN",
        "ASIAN - VIETNAMESE",
        "ASIAN - FILIPINO",
        "ASIAN - CAMBODIAN",
        "ASIAN - OTHER",
        "ASIAN - KOREAN",
        "ASIAN - JAPANESE",
        "ASIAN - THAI",
    ),
    "native": (
        "AMERICAN INDIAN/ALASKA NATIVE",
        "AMERICAN INDIAN/ALASKA NATIVE FEDERALLY RECOGNIZED TRIBE",
    ),
    "unknown": (
        "UNKNOWN/NOT SPECIFIED",
        "UNABLE TO OBTAIN",
        "PATIENT DECLINED TO ANSWER",
    ),
}

# Race by contained text, first match decides; the rest are 'Other'.
RACE_BY_TEXT = (
    ("HISPANIC", "Hispanic"),
    ("SOUTH AMERICAN", "Hispanic"),
    ("AMERICAN INDIAN", "Native American"),
    ("ASIAN", "Asian"),
    ("BLACK", "Black"),
    ("UNKNOWN/NOT SPECIFIED", "Not Specified"),
    ("WHITE", "White"),
)
RACE_PATTERN = "BLACK|WHITE|ASIAN|HISPANIC"
