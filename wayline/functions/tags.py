"""Values of map tags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """First number of a text, comma or point."""
    return F.regexp_replace(F.regexp_extract(text, r"(-?[0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")


def metres(text: Column) -> Column:
    """A height or length in metres: plain, 'm', 'km', 'ft', or feet and inches; null where unreadable."""
    t = F.lower(F.trim(text))
    v = number(t)
    inches = F.coalesce(F.regexp_extract(t, r"'\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    return (
        F.when(t.rlike(r"^[0-9.]+\s*'"), v * 0.3048 + inches * 0.0254).when(t.rlike(r"[0-9]\s*(ft|feet)"), v * 0.3048).when(t.rlike(r"[0-9]\s*km"), v * 1000)
        .when(t.rlike(r"^-?[0-9]+([.,][0-9]+)?\s*(m|metres|meters)?$"), v)
    )


def year(text: Column) -> Column:
    """A year of three or four digits in a text; centuries ('C18', '18th century') give their first year."""
    t = F.lower(text)
    century = F.coalesce(F.nullif(F.regexp_extract(t, r"\bc([0-9]{1,2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"([0-9]{1,2})(?:st|nd|rd|th) century", 1), F.lit(""))).try_cast("int")
    plain = F.nullif(F.regexp_extract(t, r"\b([0-9]{3,4})\b", 1), F.lit("")).try_cast("int")
    return F.coalesce(plain, (century - 1) * 100)


def population(text: Column) -> Column:
    """People, at least 0: the number before any semicolon, without commas and blanks; 0 where there is none."""
    v = F.regexp_replace(F.split_part(text, F.lit(";"), F.lit(1)), "[, ]", "")
    n = F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))
    return F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(0.0))


def truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(text)).isin("", "no", "false", "0"), F.lit(False))


def bits(*tests: Column) -> Column:
    """Tests as bits of a number, the first one the lowest."""
    out = F.lit(0)
    for i, t in enumerate(tests):
        out = out + F.when(F.coalesce(t, F.lit(False)), 1 << i).otherwise(0)
    return out.cast("int")


# Service groups of rail routes, and words of long-distance services.
TRAM, METRO, COMMUTER, INTERCITY, HERITAGE = range(5)
INTERCITY_WORDS = (
    "tgv", "inoui", "ouigo", "intercités", "intercites", "eurostar", "thalys", "lyria", "ave ", "alvia", "euromed", "iryo", "avlo", "talgo", "alfa pendular", "intercidades", "amtrak", "via rail", "acela", "lner",
    "avanti", "crosscountry", "cross country", "sleeper", "night riviera", "nightjet", "intercity", "inter city", "inter-city", "enterprise", "adirondack", "maple leaf", "vermonter", "ethan allen", "downeaster",
    "lake shore", "the canadian", "the ocean", "northeast regional", "hull chelsea", "transcantábrico", "costa verde express", "al andalus", "shinkansen", "新幹線", "特急", "limited express", "高鐵", "自強", "thsr",
)


def service_group(tags: Column) -> Column:
    """Service group of a rail route by its tags (a map): 0 tram, 1 metro, 2 commuter, 3 intercity, 4 heritage; null for other routes.

    Tourist and preserved lines and funiculars are heritage (metros aren't).  A train's tagged service decides; only without one do the
    words of its name, brand, network and operator."""
    tag = lambda k: F.coalesce(tags[k], F.lit(""))
    tourist = tag("service").isin("tourism", "heritage") | (tag("tourism") == "yes") | (tag("historic") == "yes") | (tag("railway:preserved") == "yes") | (tag("heritage:railway") == "yes")
    text = F.lower(F.concat_ws(" ", *[tag(k) for k in ("name", "brand", "network", "operator")]))
    named = F.lit(False)
    for w in INTERCITY_WORDS:
        named = named | text.contains(w)
    train = F.when(tourist, HERITAGE).when(tag("service").isin("long_distance", "high_speed", "night", "international", "car_shuttle"), INTERCITY).when(tags["service"].isNotNull(), COMMUTER).when(named, INTERCITY).otherwise(COMMUTER)
    return (
        F.when(tag("route") == "tram", F.when(tourist, HERITAGE).otherwise(TRAM)).when(tag("route").isin("subway", "light_rail", "monorail"), METRO)
        .when(tag("route") == "funicular", HERITAGE).when(tag("route") == "train", train)
    )


# Ranks of kinds of place.
PLACE_RANKS = {"city": 7, "town": 6, "village": 5, "suburb": 4, "hamlet": 3, "quarter": 3, "neighbourhood": 2, "locality": 1, "isolated_dwelling": 0}


def place_rank(place: Column) -> Column:
    """Rank of a kind of place, the larger the more important; null for other kinds."""
    return F.create_map(*[F.lit(x) for k, v in PLACE_RANKS.items() for x in (k, v)])[place]


def size_zoom(population_: Column, capital: Column) -> Column:
    """Zoom from which a place of that many people shows however near a more important one is: 18 less twice the logarithm, a capital half a zoom sooner; null without people."""
    return F.when(population_ > 0, 18.0 - 2.0 * F.log10(population_) - F.when(F.coalesce(capital, F.lit(False)), 0.5).otherwise(0.0))


# Keys of kana readings in order, and subtags that name the same language in another script or region.
KANA_KEYS = ("kana", "name:ja-Hira", "name:ja_kana", "name:ja-Kana")
SAME_LANGUAGE = ("Hant", "Hans", "TW", "HK", "CN", "MO", "SG")


def _present(tags: Column, key: str) -> Column:
    return F.when(F.trim(tags[key]) != "", tags[key])


def own_english(tags: Column, keys: tuple[str, ...] = ("name:en", "name_en")) -> Column:
    """The English name a thing has by its own tags: the first of ``keys``, else a romanized name (a plain Latin form, else one marked _rm, else a
    Latin form of a named system), else its kana reading in Latin letters; null without any."""
    from wayline.functions.kana import romanized

    rest = lambda k: F.regexp_extract(k, r"^name:(.*)$", 1)
    rank = lambda k: F.when(rest(k).rlike("_rm$"), 1).when(rest(k).rlike("^[^-]*-Latn$"), 0).when(rest(k).rlike("^[^-]*-Latn-[^-]*"), 2)
    latin = F.transform(F.filter(F.map_entries(tags), lambda e: e["key"].startswith("name:") & (F.trim(e["value"]) != "") & rank(e["key"]).isNotNull()), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    kana = F.coalesce(*[_present(tags, k) for k in KANA_KEYS])
    return F.coalesce(*[_present(tags, k) for k in keys], F.array_min(latin)["v"], romanized(kana))


def languages(name: Column, tags: Column) -> Column:
    """Languages a name is in by its tags, sorted: those whose name:<language> is the name itself (a script or region subtag may follow, a
    transliteration doesn't count) and those listed in ``l``."""
    same = "|".join(SAME_LANGUAGE)
    code = lambda k: F.regexp_extract(k, rf"^name:([a-z]{{2,3}})(?:[-_](?:{same}))*$", 1)
    said = F.transform(F.filter(F.map_entries(tags), lambda e: (e["value"] == name) & (code(e["key"]) != "")), lambda e: code(e["key"]))
    listed = F.filter(F.transform(F.split(F.coalesce(tags["l"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike("^[a-z]{2,3}$"))
    return F.array_sort(F.array_union(said, listed))
