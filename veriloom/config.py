"""Thresholds, fields and regulated text. Fixed values that results depend on stand here, as text."""

from __future__ import annotations

from dataclasses import dataclass

#: The mandated statement, its heading, and a phrase that each of its sentences starts with.
HEADING = "GOVERNMENT WARNING:"
MANDATED = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
SENTENCE_ANCHORS = ("according to the surgeon general", "consumption of alcoholic beverages")
BODY = SENTENCE_ANCHORS[0]
#: Phrases of the statement that rarely occur elsewhere.
WARNING_WORDS = ("surgeon", "pregnancy", "birth defects", "machinery", "impairs", "consumption", "government warning", "operate", "health problems")
#: Fixed value: the score from which a line of the second engine counts as certain.
TRUSTED_SCORE = 90
#: Characters that are read for letters of the heading.
LOOKALIKES = (("0", "o"), ("1", "i"), ("|", "i"), ("l", "i"))


@dataclass(frozen=True)
class FieldSpec:
    key: str
    label: str
    required: bool
    kind: str


#: Fixed values, in the order in which fields are reported.
FIELDS = (
    FieldSpec("brand_name", "Brand name", True, "text"),
    FieldSpec("class_type", "Class / type", True, "text"),
    FieldSpec("alcohol_content", "Alcohol content", True, "alcohol"),
    FieldSpec("net_contents", "Net contents", True, "volume"),
    FieldSpec("bottler_name_address", "Bottler name & address", False, "text"),
    FieldSpec("country_of_origin", "Country of origin", False, "country"),
)
FIELD_KEYS = tuple(f.key for f in FIELDS)
WARNING_KEYS = ("warning_wording", "warning_caps", "warning_bold")


@dataclass(frozen=True)
class Thresholds:
    """Fixed values."""

    near_match: int = 88
    find_floor: int = 60
    locate_max_lines: int = 3
    span_slack: int = 3
    whole_phrase_fields: tuple[str, ...] = ("brand_name", "class_type")
    case_review_fields: tuple[str, ...] = ("brand_name",)
    brand_small_print_ratio: float = 0.5
    conflict_floor: int = 70
    abv_tolerance: float = 0.05
    proof_tolerance: float = 0.5
    volume_tolerance_ml: float = 0.5
    volume_cross_share: float = 0.005
    warning_near: int = 97
    bold_ratio: float = 1.30
    bold_min_text_px: int = 14
    unreadable_min_words: int = 8
    unreadable_word_conf: int = 70
    reread_max_lines: int = 4
    reread_max_edits: int = 1
    same_place_overlap: float = 0.6
    clear_min_conf: float = 60
    clear_mean_conf: float = 80
    clear_plausible: float = 0.8
    clear_min_chars: int = 3
    clear_label_share: float = 0.9
    clear_label_low_share: float = 0.1
    clear_warning_words: int = 2
    clear_warning_conf: float = 90
    poor_image_unclear: int = 2
    column_tolerance: float = 0.25
    column_min_lines: int = 2
    column_min_words: int = 8
    line_overlap: float = 0.5
    meaning_conf: int = 70
    meaning_gap: float = 1.2
    meaning_min_score: int = 90
    meaning_missing: tuple[str, ...] = ("not", "should", "may")
    meaning_inserted: tuple[str, ...] = ("not", "no", "never", "only", "sometimes", "rarely", "seldom", "occasionally", "always", "usually", "often", "hardly", "cannot", "possibly", "barely")
    meaning_substitutes: tuple[tuple[str, str], ...] = (
        ("not", "now also always only ever even then too just still often rather soon"),
        ("should", "can could may might must will would shall need do does cannot"),
        ("may", "can could might must will would shall should need do does cannot"),
        ("women", "men man woman people persons adults children kids mothers girls ladies everyone anyone nobody wives"),
        ("pregnancy", "childhood infancy adolescence nursing breastfeeding lactation meals work holidays"),
        ("birth", "brain heart liver mental physical"),
        ("defects", "weight"),
        ("impairs", "improves improve enhances enhance increases increase boosts boost helps aids sharpens benefits affects affect reduces reduce"),
        ("drive", "ride walk fly steer park own buy"),
        ("car", "vehicle truck boat bike bicycle plane horse bus"),
        ("operate", "use run own fix repair build"),
        ("machinery", "machines equipment tools vehicles computers"),
        ("cause", "prevent prevents cure cures avoid reduce solve treat ease"),
        ("health", "wealth heart money legal family financial"),
        ("problems", "benefits improvements"),
        ("surgeon", "attorney president secretary doctor physician governor"),
        ("drink", "eat consume buy sell serve enjoy use taste touch try smoke"),
    )


THRESHOLDS = Thresholds()

#: Punctuation at the edges of a value, and what separates phrases on a line.
EDGE_PUNCTUATION = " ,.;:-|'\"()[]"
SEPARATORS = ",;:|/·•-()[]."
#: Letter shapes that reading confuses, in the order in which they are replaced.
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("|", "l"), ("i", "l"), ("5", "s"), ("8", "b"))
#: Container sizes in mL that are in use.
STANDARD_ML = (50, 100, 180, 187, 200, 250, 300, 331, 350, 355, 365, 375, 473, 475, 500, 568, 570, 600, 620, 650, 700, 710, 720, 750, 900, 945, 946, 1000, 1500, 1750, 1800, 2000, 2250, 3000, 3750)
#: Units (canonical name, millilitres, spellings).
UNITS = (
    ("mL", 1.0, ("ml", "milliliter", "millilitre")),
    ("cL", 10.0, ("cl", "centiliter", "centilitre")),
    ("L", 1000.0, ("l", "liter", "litre")),
    ("fl oz", 29.5735, ("floz", "fluidounce", "oz", "ounce")),
    ("pt", 473.176, ("pt", "pint")),
    ("qt", 946.353, ("qt", "quart")),
    ("gal", 3785.41, ("gal", "gallon")),
)
METRIC = ("mL", "L", "cL")
#: What introduces a country, and a name that is none.
ORIGIN_PREFIXES = ("product of", "produce of", "produced in", "made in", "imported from", "distilled in", "bottled in")
NOT_COUNTRIES = ("bond",)
#: Worst first when several statuses meet; the order of triage.
STATUS_RANK = {"REVIEW": 0, "FAIL": 1, "ERROR": 2, "PASS": 3, "PENDING": 4}

#: Origins that are not imports.
US_PLACES = (
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT", "DELAWARE", "FLORIDA", "GEORGIA", "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY",
    "LOUISIANA", "MAINE", "MARYLAND", "MASSACHUSETTS", "MICHIGAN", "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA", "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK",
    "NORTH CAROLINA", "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON", "PENNSYLVANIA", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA", "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA",
    "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING", "DISTRICT OF COLUMBIA", "PUERTO RICO", "U.S. VIRGIN ISLANDS", "VIRGIN ISLANDS", "GUAM", "AMERICAN", "UNITED STATES",
)
