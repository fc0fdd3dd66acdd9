"""The reference table of festival demand, and its loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema as S

# Festival, direction, category, multiplier and items of the reference table, in its order.
RULES = [
    ("diwali", "up", "sweets, dairy, dry fruits, oil", 2.0, "milk, khoya, paneer, ghee, sugar, dry fruits, besan, oil, snacks, mithai"),
    ("diwali", "up", "lighting, decoration", 2.5, "diya, diyas, oil lamp, candle, candles, tea light, string lights, fairy lights, lantern, kandil, toran, rangoli, rangoli colour, decoration, decorations"),
    ("diwali", "up", "gifting", 1.9, "gift box, gift set, gift hamper, gift pack, dry fruit box, chocolate box, sweet box"),
    ("holi", "up", "dairy, sweets", 1.6, "milk, khoya, paneer, sugar, gujiya, mawa, thandai"),
    ("holi", "up", "colours, water play", 2.2, "gulal, colours, colors, holi colour, holi colours, pichkari, water gun, water guns, water balloon, water balloons, spray colour"),
    ("holi", "up", "clothing", 1.5, "white kurta, white shirt, white t shirt, white tshirt, white dupatta"),
    ("maha_shivaratri", "up", "fasting foods, dairy, fruit", 1.5, "sabudana, singhara, kuttu, kuttu atta, rajgira, samak, samak rice, sendha namak, rock salt, makhana, milk, curd, fruits, potatoes"),
    ("maha_shivaratri", "down", "non-veg, alliums", 0.8, "onion, garlic, chicken, mutton, fish, eggs"),
    ("raksha_bandhan", "up", "sweets, gifting", 1.4, "sweets, mithai, dry fruits, chocolates, milk, rakhi, gift box, gift pack"),
    ("eid_al_fitr", "up", "dairy, sweets, meat", 1.8, "milk, vermicelli, seviyan, dry fruits, sugar, ghee, meat, dates"),
    ("christmas", "up", "bakery, dairy", 1.5, "cake, plum cake, butter, cream, dry fruits, chocolates, wine"),
    ("independence_day", "up", "snacks, soft drinks", 1.12, "packaged snacks, chips, namkeen, biscuits, soft drink, soft drinks, cold drink, cold drinks, soda"),
    ("independence_day", "up", "flags, bunting", 1.6, "flag, flags, national flag, tricolour, tiranga, bunting, flag badge, paper flag"),
    ("republic_day", "up", "snacks, soft drinks", 1.1, "packaged snacks, chips, namkeen, biscuits, soft drink, soft drinks, cold drink, cold drinks, soda"),
    ("republic_day", "up", "flags, bunting", 1.5, "flag, flags, national flag, tricolour, tiranga, bunting, flag badge, paper flag"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "row int, festival_key string, direction string, category string, suggested_multiplier double, items string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from a CSV file; a row whose direction and multiplier disagree, or without items, is an error."""
    rows = spark.read.csv(path, header=True, schema=S.demand_rules())
    wrong = (F.col("direction") == "up") & (F.col("suggested_multiplier") < 1) | (F.col("direction") == "down") & (F.col("suggested_multiplier") > 1)
    bad = rows.where(wrong | F.col("suggested_multiplier").isNull() | (F.col("suggested_multiplier") <= 0) | ~F.col("direction").isin("up", "down") | F.col("items").isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"rules that contradict themselves: {bad}")
    return rows.withColumn("row", F.monotonically_increasing_id().cast("int"))  # order of the file; a small table
