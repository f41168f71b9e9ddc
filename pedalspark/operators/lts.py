"""Level of traffic stress of streets and junctions: ordered rule tables over one scan.

Stress is 0 where cycling is not permitted, 1 (lowest) to 4 else. Each table lists (code, stress, predicate); the first
rule that holds decides. No table is split and put together again. Assumed values, rule and stress are computed once for
each street, one after another (``settled``): a filter on stress tests a column, it doesn't repeat the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import any_is, family, first_match, is_, not_, parts, tag, with_tags

# Road classes that the analysis keeps.
MAJOR_ROADS = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "cycleway", "living_street", "unclassified", "motorway", "motorway_link", "pedestrian", "steps", "track"]
TRUNK_ROADS = ["trunk", "trunk_link"]
# Tag values of bike lanes and of parking.
LANE_VALUES = ["crossing", "lane", "left", "opposite", "opposite_lane", "right", "yes"]
PARKING_VALUES = ["yes", "parallel", "perpendicular", "diagonal", "marked"]
# Stress of each rule.
STRESS = {
    "p2": 0, "p6": 0, "p3": 0, "p4": 0, "p7": 0, "p5": 0,
    "s3": 1, "s1": 1, "s2": 1, "s7": 1, "s8": 1,
    "b1": 1, "b2": 3, "b3": 3, "b4": 2, "b5": 2, "b6": 2, "b7": 3, "b8": 4, "b9": 3,
    "m17": 1, "m13": 1, "m14": 2, "m2": 2, "m15": 2, "m3": 2, "m4": 2, "m16": 2, "m5": 2, "m6": 3, "m7": 3, "m8": 4, "m9": 2, "m10": 3, "m11": 4, "m12": 4,
}
SLOPE_CLASSES = ["0-3: flat", "3-5: mild", "5-8: medium", "8-10: hard", "10-20: extreme", ">20: impossible"]


def major_roads(edges: DataFrame, trunk: bool = False) -> DataFrame:
    return edges.filter(F.col("highway").isin(MAJOR_ROADS + TRUNK_ROADS * trunk))


def permitted_rule() -> Column:
    """p0 where cycling is permitted."""
    return first_match([
        ("p2", is_("bicycle", "no")),
        ("p6", is_("access", "no")),
        ("p3", is_("highway", "motorway")),
        ("p4", is_("highway", "motorway_link")),
        ("p7", is_("highway", "proposed")),
        ("p5", is_("footway", "sidewalk") & not_("bicycle", "yes") & is_("highway", "footway", "path")),
    ], "p0")


def separated_rule(cycleway: list[str]) -> Column:
    """s0 where the way is not apart from traffic."""
    return first_match([
        ("s3", is_("highway", "cycleway")),
        ("s1", is_("highway", "path")),
        ("s2", is_("highway", "footway") & not_("footway", "crossing")),
        ("s7", any_is(cycleway, "track")),
        ("s8", any_is(cycleway, "opposite_track")),
    ], "s0")


def bike_lane(cycleway: list[str]) -> Column:
    return any_is(cycleway, *LANE_VALUES) | is_("shoulder:access:bicycle", "yes")


def parking_present(parking: list[str]) -> Column:
    return any_is(parking, *PARKING_VALUES)


def lanes_assumed(df: DataFrame, default: int = 2) -> Column:
    """1 on one-way streets whatever the tag says; else the largest number of the tag."""
    largest = F.array_max(F.transform(parts(df, "lanes"), lambda x: x.try_cast("double").cast("int")))
    return F.when(F.coalesce("oneway", F.lit(False)), 1).otherwise(F.coalesce(largest, F.lit(default)))


def maxspeed_assumed(df: DataFrame, national: int = 90, local: int = 50, motorway: int = 130, primary: int = 90, secondary: int = 90, urban: int = 50) -> Column:
    """The largest speed of the tag, in km/h; by road class where there is no tag."""
    by_class = F.when(is_("highway", "motorway"), motorway).when(is_("highway", "primary"), primary).when(is_("highway", "secondary"), secondary).when(is_("highway", "urban"), urban).otherwise(local)
    speed = lambda x: F.when(x == "national", national).when(x == "IT:urban", urban).otherwise(x.try_cast("double").cast("int"))
    return F.when(tag("maxspeed").isNull(), by_class).otherwise(F.coalesce(F.array_max(F.transform(parts(df, "maxspeed"), speed)), F.lit(local)))


def width_assumed() -> Column:
    """Metres: the tag, an estimate, or by road class, halved on one-way streets other than motorways."""
    by_class = F.when(is_("highway", "motorway"), 11.25).when(is_("highway", "primary"), 7.0).when(is_("highway", "secondary"), 6.0).otherwise(5.0)
    halved = F.when(F.coalesce("oneway", F.lit(False)) & not_("highway", "motorway"), by_class / 2).otherwise(by_class)
    return F.coalesce(tag("width").cast("double"), tag("est_width").cast("double"), halved)


def lane_rule(lanes: Column, speed: Column, width: Column) -> Column:
    """Streets with a bike lane, with parking or without."""
    residential = is_("highway", "residential")
    return first_match([
        ("b2", (lanes >= 3) & (speed <= 55)),
        ("b3", width <= 4.1),
        ("b4", width <= 4.25),
        ("b5", (width <= 4.5) & (speed <= 40) & residential),
        ("b6", (speed > 40) & (speed <= 50)),
        ("b7", (speed > 50) & (speed <= 55)),
        ("b8", speed > 55),
        ("b9", ~residential),
    ], "b1")


def mixed_rule(lanes: Column, speed: Column) -> Column:
    """Streets shared with motor traffic; m0 (no stress) if no rule holds."""
    service, residential = is_("highway", "service"), is_("highway", "residential")
    return first_match([
        ("m17", is_("motor_vehicle", "no")),
        ("m13", is_("highway", "pedestrian")),
        ("m14", is_("highway", "footway") & is_("footway", "crossing")),
        ("m2", service & is_("service", "alley")),
        ("m15", is_("highway", "track")),
        ("m3", (speed <= 50) & service & is_("service", "parking_aisle")),
        ("m4", (speed <= 50) & service & is_("service", "driveway")),
        ("m16", (speed <= 35) & service),
        ("m5", (speed <= 40) & residential & (lanes <= 3)),
        ("m6", (speed <= 40) & (lanes <= 3)),
        ("m7", (speed <= 40) & (lanes <= 5)),
        ("m8", (speed <= 40) & (lanes > 5)),
        ("m9", (speed <= 50) & residential & (lanes < 3)),
        ("m10", (speed <= 50) & (lanes <= 3)),
        ("m11", (speed <= 50) & (lanes > 3)),
        ("m12", speed > 50),
    ], "m0")


def stress_of(rule: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STRESS.items() for x in pair))
    return F.try_element_at(table, rule)


def fenced(value: Column) -> Column:
    """``value`` behind a test that always holds, which keeps the optimizer from repeating it in filters below its projection."""
    return F.when(2 * F.rand(0) >= 0, value)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that later expressions and filters refer to without computing them anew; columns nobody asks for are pruned."""
    return df.select(*(tag(c) for c in df.columns if c not in columns), *(fenced(v).alias(c) for c, v in columns.items()))


def classify(edges: DataFrame) -> DataFrame:
    """``edges`` with lanes_assumed, maxspeed_assumed, width_assumed, path_class, rule and base_lts.

    path_class: not_permitted, separated, lane_parking, lane_no_parking or mixed; each street has one.
    """
    cycleway, parking = family(edges, "cycleway"), family(edges, "parking")
    df = with_tags(edges)
    df = settled(df, lanes_assumed=lanes_assumed(df), maxspeed_assumed=maxspeed_assumed(df), width_assumed=width_assumed(), _p=permitted_rule(), _s=separated_rule(cycleway), _l=bike_lane(cycleway), _k=parking_present(parking))
    lanes, speed, width = F.col("lanes_assumed"), F.col("maxspeed_assumed"), F.col("width_assumed")
    path = F.when(F.col("_p") != "p0", "not_permitted").when(F.col("_s") != "s0", "separated").when(F.col("_l") & F.col("_k"), "lane_parking").when(F.col("_l"), "lane_no_parking").otherwise("mixed")
    rule = F.when(F.col("_p") != "p0", F.col("_p")).when(F.col("_s") != "s0", F.col("_s")).when(F.col("_l"), lane_rule(lanes, speed, width)).otherwise(mixed_rule(lanes, speed))
    df = settled(settled(df, path_class=path, rule=rule), base_lts=stress_of(F.col("rule")))
    added = ["lanes_assumed", "maxspeed_assumed", "width_assumed", "path_class", "rule", "base_lts"]
    return df.select(*(tag(c) for c in dict.fromkeys([*edges.columns, *added])))


def slope_class(slope: Column) -> Column:
    """Left-closed classes of a slope in percent; null below 0."""
    out = F.when(slope < 0, F.lit(None).cast("string"))
    for top, name in zip((3, 5, 8, 10, 20), SLOPE_CLASSES):
        out = out.when(slope < top, name)
    return out.when(slope.isNotNull(), SLOPE_CLASSES[-1])


def penalised(lts: str = "base_lts", legacy: bool = False, protect_not_allowed: bool = False) -> Column:
    """Stress after slope and length, at most 4. ``legacy``: medium slopes count as hard. In towns a medium or hard slope of unknown length has no stress."""
    at, length = F.col("slope_class"), F.col("length")
    flat, mild, medium, hard, extreme, impossible = SLOPE_CLASSES
    long_ = length >= 500
    steep = F.when(long_, 2).when(length.isNotNull(), 1)
    medium_step = steep if legacy else F.when(long_, 1).when(length.isNotNull(), 0)
    town = F.when(at == medium, medium_step).when(at == hard, steep).when(at.isin(extreme, impossible), 2).otherwise(0)
    country = F.when(at.isin(hard, extreme, impossible), F.when(long_, 2).otherwise(1)).otherwise(0)
    step = F.when(F.col("context") == "urban", town).otherwise(country)
    base = F.col(lts)
    out = F.when(base.isNotNull() & step.isNotNull(), F.least(base + step, F.lit(4)))
    return F.when(base == 0, 0).otherwise(out) if protect_not_allowed else out


def edge_stress(edges: DataFrame, **penalty: bool) -> DataFrame:
    """``edges`` (tags, slope, length, context) with rule, base_lts, slope_class, lts and both messages."""
    df = classify(edges)
    if "slope" in edges.columns:
        df = df.withColumn("slope_class", slope_class(F.col("slope")))
    df = settled(with_tags(df), lts=penalised(**penalty))
    lookup = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("rule"))
    return df.withColumns({"message": lookup(MESSAGES), "short_message": lookup(SHORT_MESSAGES)})


def node_stress(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, highway) with lts and message, from the highest stress of the streets that leave each node."""
    top = edges.groupBy(F.col("u").alias("node")).agg(F.max("lts").alias("_max"), F.count("*").alias("_n"))
    df = nodes.join(top, "node", "left")
    high, signals, stop = F.col("_max") > 2, is_("highway", "traffic_signals"), is_("highway", "stop")
    lts = F.when(high & signals, 2).when(~high & (signals | stop), 1).otherwise(F.col("_max"))
    message = F.when(F.col("_n").isNull(), "Node not found in edges").when(high & signals, "LTS 3-4 with traffic signals").when(~high & (signals | stop), "LTS 1-2 with traffic signals or stop").otherwise("Node LTS is max intersecting LTS")
    return df.withColumns({"lts": lts, "message": message}).drop("_max", "_n")


def stress_class(lts: Column) -> Column:
    return F.when(lts.isin(1, 2), "low").when(lts.isin(3, 4), "high")


def stress_text(lts: Column) -> Column:
    return F.when(lts.isin(1, 2), "low stress").when(lts.isin(3, 4), "high stress").otherwise("undefined")


# Words of streets that bar bicycles, and of those that don't.
MOTORWAY_WORDS = "tangenziale|superstrada|strada statale|autostrada|strada a scorrimento veloce"
CYCLE_WORDS = "bici|cicla|ciclo"


def bars_bicycles(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike(MOTORWAY_WORDS) & ~low.rlike(CYCLE_WORDS)


def display_class(name: Column, lts: Column) -> Column:
    return F.when(bars_bicycles(name), "not cyclable").when(lts.between(1, 4), lts.cast("int").cast("string")).otherwise("undefined")


def city_name(place: Column) -> Column:
    """"Bolzano - Bozen, Italy" -> "Bolzano"; blanks become underscores."""
    return F.replace(F.trim(F.split(F.split(place, ",")[0], "-")[0]), F.lit(" "), F.lit("_"))


def stress_counts(df: DataFrame, lts: str = "lts") -> DataFrame:
    return df.filter(F.col(lts) > 0).groupBy(lts).agg(F.count("*").alias("n"))


def stress_summary(df: DataFrame, lts: str = "lts") -> DataFrame:
    """n, mean, median and population deviation of stress above 0."""
    x = F.col(lts)
    return df.filter(x > 0).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"))


# What the rules say.
MESSAGES = {
    "p2": "Cycling not permitted due to bicycle='no' tag.",
    "p6": "Cycling not permitted due to access='no' tag.",
    "p3": "Cycling not permitted due to highway='motorway' tag.",
    "p4": "Cycling not permitted due to highway='motorway_link' tag.",
    "p7": "Cycling not permitted due to highway='proposed' tag.",
    "p5": "Cycling not permitted. When footway=\"sidewalk\" is present, there must be a bicycle=\"yes\" when the highway is \"footway\" or \"path\".",
    "s3": "This way is a separated path because highway='cycleway'.",
    "s1": "This way is a separated path because highway='path'.",
    "s2": "This way is a separated path because highway='footway' but it is not a crossing.",
    "s7": "This way is a separated path because cycleway* is defined as 'track'.",
    "s8": "This way is a separated path because cycleway* is defined as 'opposite_track'.",
    "b1": "LTS is 1 because there is parking present, the maxspeed is less than or equal to 40, highway=\"residential\", and there are 2 lanes or less.",
    "b2": "Increasing LTS to 3 because there are 3 or more lanes and parking present.",
    "b3": "Increasing LTS to 3 because the bike lane width is less than 4.1m and parking present.",
    "b4": "Increasing LTS to 2 because the bike lane width is less than 4.25m and parking present.",
    "b5": "Increasing LTS to 2 because the bike lane width is less than 4.5m, maxspeed is less than 40 on a residential street and parking present.",
    "b6": "Increasing LTS to 2 because the maxspeed is between 41-50 km/h and parking present.",
    "b7": "Increasing LTS to 3 because the maxspeed is between 51-54 km/h and parking present.",
    "b8": "Increasing LTS to 4 because the maxspeed is over 55 km/h and parking present.",
    "b9": "Increasing LTS to 3 because highway is not 'residential'.",
    "m17": "Setting LTS to 1 because motor_vehicle='no'.",
    "m13": "Setting LTS to 1 because highway='pedestrian'.",
    "m14": "Setting LTS to 2 because highway='footway' and footway='crossing'.",
    "m2": "Setting LTS to 2 because highway='service' and service='alley'.",
    "m15": "Setting LTS to 2 because highway='track'.",
    "m3": "Setting LTS to 2 because maxspeed is 50 km/h or less and service is 'parking_aisle'.",
    "m4": "Setting LTS to 2 because maxspeed is 50 km/h or less and service is 'driveway'.",
    "m16": "Setting LTS to 2 because maxspeed is less than 35 km/h and highway='service'.",
    "m5": "Setting LTS to 2 because maxspeed is up to 40 km/h, 3 or fewer lanes and highway='residential'.",
    "m6": "Setting LTS to 3 because maxspeed is up to 40 km/h and 3 or fewer lanes on non-residential highway.",
    "m7": "Setting LTS to 3 because maxspeed is up to 40 km/h and 4 or 5 lanes.",
    "m8": "Setting LTS to 4 because maxspeed is up to 40 km/h and the number of lanes is greater than 5.",
    "m9": "Setting LTS to 2 because maxspeed is up to 50 km/h and lanes are 2 or less and highway='residential'.",
    "m10": "Setting LTS to 3 because maxspeed is up to 50 km/h and lanes are 3 or less on non-residential highway.",
    "m11": "Setting LTS to 4 because the number of lanes is greater than 3.",
    "m12": "Setting LTS to 4 because maxspeed is greater than 50 km/h.",
}
SHORT_MESSAGES = {
    "p2": "bicycle $=$ \"no\"",
    "p6": "access $=$ \"no\"",
    "p3": "highway $=$ \"motorway\"",
    "p4": "highway $=$ \"motorway_link\"",
    "p7": "highway $=$ \"proposed\"",
    "p5": "footway $=$ \"sidewalk\", bicycle$\\neq$\"yes\"",
    "s3": "highway $=$ \"cycleway\"",
    "s1": "highway $=$\" path\"",
    "s2": "separated, highway $=$\" footway\", not a crossing",
    "s7": "cycleway* $=$ \"track\"",
    "s8": "cycleway* $=$ \"opposite_track\"",
    "b1": "bike lane w/ parking, $\\leq$ 40 km/h, highway $=$ \"residential\", $\\leq$ 2 lanes",
    "b2": "bike lane w/ parking, 3 or more lanes",
    "b3": "bike lane width $<$ 4.1m, parking",
    "b4": "bike lane width $<$ 4.25m, parking",
    "b5": "bike lane width $<$ 4.5m, $\\leq$ 40 km/h, residential, parking",
    "b6": "bike lane w/ parking, speed 41-50 km/h",
    "b7": "bike lane w/ parking, speed 51-54 km/h",
    "b8": "bike lane w/ parking, speed $>$ 55 km/h",
    "b9": "bike lane w/ parking, highway $\\neq$ \"residential\"",
    "m17": "mixed traffic, motor_vehicle $=$ \"no\"",
    "m13": "mixed traffic, highway $=$ \"pedestrian\"",
    "m14": "mixed traffic, highway $=$ \"footway\", footway $=$ \"crossing\"",
    "m2": "mixed traffic, highway $=$ \"service\", service $=$ \"alley\"",
    "m15": "mixed traffic, highway $=$ \"track\"",
    "m3": "mixed traffic, speed $\\leq$ 50 km/h, service $=$ \"parking_aisle\"",
    "m4": "mixed traffic, speed $\\leq$ 50 km/h, service $=$ \"driveway\"",
    "m16": "mixed traffic, speed $\\leq$ 35 km/h, highway $=$ \"service\"",
    "m5": "mixed traffic, speed $\\leq$ 40 km/h, highway $=$ \"residential\", $\\leq$ 3 lanes",
    "m6": "mixed traffic, speed $\\leq$ 40 km/h, highway $\\neq$ \"residential\", $\\leq$ 3 lanes",
    "m7": "mixed traffic, speed $\\leq$ 40 km/h, 4 or 5 lanes",
    "m8": "mixed traffic, speed $\\leq$ 40 km/h, lanes $>$ 5",
    "m9": "mixed traffic, speed $\\leq$ 50 km/h, highway $=$ \"residential\",$\\leq$ 2 lanes",
    "m10": "mixed traffic, speed $\\leq$ 50 km/h, highway $\\neq$ \"residential\", $\\leq$ 3 lanes",
    "m11": "mixed traffic, speed $\\leq$ 50 km/h, lanes $>$ 3",
    "m12": "mixed traffic, speed $>$ 50 km/h",
}
