"""Generated applications and labels: each key draws its category, names, figures and defect by hash, so a row is the same wherever and however often it is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import general_number

#: What is drawn, with weights. Figures are in percent and in bottle sizes that are in use.
CATEGORIES = (("spirits", 40), ("wine", 25), ("beer", 20), ("import", 15))
FIRST = ("Amber", "Birch", "Cobalt", "Dusty", "Ember", "Frosty", "Gilded", "Hazel", "Ivory", "Jade")
SECOND = ("Badger", "Canyon", "Dory", "Egret", "Furrow", "Glacier", "Heron", "Inlet", "Juniper", "Kestrel", "Ledge", "Marsh")
KINDS = {
    "spirits": (("Bourbon Whiskey", "Vodka", "London Dry Gin", "Silver Rum"), (40.0, 43.0, 45.0, 47.5, 50.0), ("750 mL", "1 L", "1.75 L", "375 mL")),
    "wine": (("Chardonnay", "Pinot Noir", "Red Table Wine"), (11.5, 12.0, 12.5, 13.5, 14.5), ("750 mL", "1.5 L", "375 mL")),
    "beer": (("India Pale Ale", "Oatmeal Stout", "Pilsner"), (4.2, 5.0, 5.5, 6.8, 9.0), ("355 mL", "473 mL", "750 mL")),
    "import": (("Tequila Blanco", "Irish Whiskey", "Cognac"), (40.0, 43.0, 46.0), ("700 mL", "750 mL", "1 L")),
}
ORIGINS = ("Mexico", "Ireland", "France")
DEFECTS = (("clean", 78), ("wrong_abv", 7), ("wrong_net_contents", 6), ("missing_net_contents", 4), ("brand_case", 5))
EXPECTED = {"clean": "PASS", "wrong_abv": "FAIL", "wrong_net_contents": "FAIL", "missing_net_contents": "FAIL", "brand_case": "REVIEW"}
#: Hashes are numbers below this.
WHOLE = 16**6


def hashed(key: Column, what: str) -> Column:
    """A number below WHOLE for a key, another one for each thing that is drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{what}:"), key.cast("string"))), 1, 6), 16, 10).cast("long")


def draw(key: Column, what: str, options, weights=None) -> Column:
    """One of the options by their weights (equal ones without); their running shares of WHOLE decide."""
    weights = weights or [1] * len(options)
    out, upto = F.lit(options[-1]), []
    for w in weights:
        upto.append((upto[-1] if upto else 0) + w)
    for option, limit in reversed(list(zip(options[:-1], upto))):
        out = F.when(hashed(key, what) < -(-limit * WHOLE // upto[-1]), F.lit(option)).otherwise(out)
    return out


def wrong_abv(abv: Column) -> Column:
    """Another percentage: five points more, or one and a half for a weak drink. (GEN4)"""
    return abv + F.when(abv > 20, 5.0).otherwise(1.5)


def wrong_volume(volume: Column) -> Column:
    """Another size of bottle. (GEN4)"""
    return F.when(volume == "1 L", "750 mL").otherwise("1 L")


def applications(keys: DataFrame) -> DataFrame:
    """Applications for keys (label_id), with what their labels carry: category, defect, the label's abv and volume, and the status that is expected. (GEN2, GEN3, GEN4)"""
    k = F.col("label_id")
    rows = keys.select("label_id", draw(k, "category", [c for c, _ in CATEGORIES], [w for _, w in CATEGORIES]).alias("category"), draw(k, "defect", [d for d, _ in DEFECTS], [w for _, w in DEFECTS]).alias("defect"))

    def by_category(place: int, what: str) -> Column:
        out = F.lit(None)
        for category, lists in KINDS.items():
            out = F.when(F.col("category") == category, draw(k, what, lists[place])).otherwise(out)
        return out

    country = F.when(F.col("category") == "import", draw(k, "class", ORIGINS)).otherwise("")
    rows = rows.withColumns({"brand_name": F.concat_ws(" ", draw(k, "first", FIRST), draw(k, "second", SECOND)), "class_type": by_category(0, "class"), "abv": by_category(1, "abv"), "net_contents": by_category(2, "volume"), "country_of_origin": country})
    shown = F.when(F.col("defect") == "wrong_abv", wrong_abv(F.col("abv"))).otherwise(F.col("abv"))
    volume = F.when(F.col("defect") == "wrong_net_contents", wrong_volume(F.col("net_contents"))).when(F.col("defect") != "missing_net_contents", F.col("net_contents"))
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])[F.col("defect")]
    return rows.withColumns({"alcohol_content": F.concat(general_number(F.col("abv")), F.lit("% Alc./Vol.")), "label_abv": shown, "label_volume": volume, "expected": expected})


def label_lines(rows: DataFrame) -> DataFrame:
    """(label_id, line_no, text): what the labels of generated applications say."""
    brand = F.when(F.col("defect") == "brand_case", F.upper("brand_name")).otherwise(F.col("brand_name"))
    figure = general_number(F.col("label_abv"))
    style = draw(F.col("label_id"), "style", (0, 1, 2))
    alcohol = F.when(style == 0, F.concat(figure, F.lit("% ALC./VOL."))).when(style == 1, F.concat(F.lit("ALC. "), figure, F.lit("% BY VOL."))).otherwise(F.concat(F.lit("Alcohol "), figure, F.lit("% by Volume")))
    origin = F.when(F.col("country_of_origin") != "", F.concat(F.lit("Product of "), "country_of_origin"))
    return rows.select("label_id", F.posexplode(F.array_compact(F.array(brand, F.col("class_type"), alcohol, F.col("label_volume"), origin))).alias("line_no", "text"))
