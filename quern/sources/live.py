"""Live data as tables: stored answers of weather, currency, crypto, stock and indicator services, parsed. Answers: (key, status, body); only good ones count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: conditions by code, indicators (name, code, label), letters of names, seconds that an answer lives ----
CONDITIONS = [
    (0, "açık"), (1, "az bulutlu"), (2, "parçalı bulutlu"), (3, "çok bulutlu"), (45, "sisli"), (48, "kırağılı sis"), (51, "hafif çisenti"), (53, "çisenti"),
    (55, "yoğun çisenti"), (61, "hafif yağmur"), (63, "yağmur"), (65, "kuvvetli yağmur"), (71, "hafif kar"), (73, "kar"), (75, "yoğun kar"), (77, "kar taneleri"),
    (80, "sağanak"), (81, "kuvvetli sağanak"), (82, "şiddetli sağanak"), (95, "gök gürültülü fırtına"), (96, "dolulu fırtına"), (99, "şiddetli dolulu fırtına"),
]
INDICATORS = [
    ("gdp", "NY.GDP.MKTP.CD", "GSYİH (cari ABD doları)"),
    ("gdp_per_capita", "NY.GDP.PCAP.CD", "Kişi başına GSYİH (cari ABD doları)"),
    ("population", "SP.POP.TOTL", "Nüfus"),
    ("inflation", "FP.CPI.TOTL.ZG", "Enflasyon, TÜFE (yıllık %)"),
    ("unemployment", "SL.UEM.TOTL.ZS", "İşsizlik (işgücünün %'si)"),
    ("life_expectancy", "SP.DYN.LE00.IN", "Doğumda beklenen yaşam süresi"),
    ("internet_users", "IT.NET.USER.ZS", "İnternet kullanan nüfus (%)"),
    ("co2", "EN.GHG.CO2.PC.CE.AR5", "Kişi başına CO2 (ton)"),
]
LETTERS = ("ıİğĞüÜşŞöÖçÇI", "iigguussoocci")
# ---------------------------------------------------------------------------------------------------------------------


def _parsed(answers: DataFrame, schema: str) -> DataFrame:
    return answers.where("status between 200 and 299").select("key", F.from_json("body", schema).alias("b")).where("b is not null")


def condition(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in CONDITIONS for v in pair]), code.cast("int"))


def weather(answers: DataFrame) -> DataFrame:
    """(key, observed_at, temperature_c, feels_like_c, humidity_pct, precipitation_mm, wind_kmh, weather_code, condition) now."""
    now = "struct<time:string,temperature_2m:double,apparent_temperature:double,relative_humidity_2m:double,precipitation:double,weather_code:int,wind_speed_10m:double>"
    names = [("time", "observed_at"), ("temperature_2m", "temperature_c"), ("apparent_temperature", "feels_like_c"), ("relative_humidity_2m", "humidity_pct"), ("precipitation", "precipitation_mm"), ("wind_speed_10m", "wind_kmh"), ("weather_code", "weather_code")]
    return _parsed(answers, f"current {now}").select("key", *[F.col(f"b.current.{a}").alias(b) for a, b in names], condition(F.col("b.current.weather_code")).alias("condition"))


def forecast(answers: DataFrame) -> DataFrame:
    """(key, date, condition, max_c, min_c, precipitation_mm): the parallel lists of days as rows; what a list lacks is null."""
    own = _parsed(answers, "daily struct<time:array<string>,weather_code:array<int>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_sum:array<double>>")
    days = own.select("key", F.posexplode("b.daily.time").alias("i", "date"), "b")
    at = lambda x: F.get(F.col(f"b.daily.{x}"), F.col("i"))
    return days.select("key", "date", condition(at("weather_code")).alias("condition"), at("temperature_2m_max").alias("max_c"), at("temperature_2m_min").alias("min_c"), at("precipitation_sum").alias("precipitation_mm"))


def fx(answers: DataFrame) -> DataFrame:
    """(key, base, date, currency, rate); the date is that of the rates."""
    own = _parsed(answers, "base string, date string, rates map<string,double>")
    return own.select("key", F.coalesce(F.col("b.base"), F.upper("key")).alias("base"), F.col("b.date").alias("date"), F.explode("b.rates").alias("currency", "rate"))


def crypto(answers: DataFrame) -> DataFrame:
    """(key, asset, currency, price, change_24h, observed_at); observed_at: the latest change of the whole answer."""
    own = _parsed(answers.withColumn("body", F.concat(F.lit('{"m":'), "body", F.lit("}"))), "m map<string,map<string,double>>").select("key", F.col("b.m").alias("m"))
    own = own.withColumn("observed_at", F.timestamp_seconds(F.array_max(F.transform(F.map_values("m"), lambda v: F.try_element_at(v, F.lit("last_updated_at"))))))
    own = own.select("key", "observed_at", F.explode("m").alias("asset", "v")).select("key", "observed_at", "asset", "v", F.explode("v").alias("currency", "price"))
    own = own.where("currency <> 'last_updated_at' and not endswith(currency, '_24h_change')")
    return own.select("key", "asset", "currency", "price", F.try_element_at("v", F.concat("currency", F.lit("_24h_change"))).alias("change_24h"), "observed_at")


def stock(answers: DataFrame) -> DataFrame:
    """(key, symbol, name, currency, price, previous_close, change, change_pct, observed_at, closes); closes without gaps, as (date, close)."""
    meta = "struct<symbol:string,longName:string,shortName:string,currency:string,regularMarketPrice:double,chartPreviousClose:double,previousClose:double,regularMarketTime:bigint>"
    own = _parsed(answers, f"chart struct<result:array<struct<meta:{meta},timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>").select("key", F.get("b.chart.result", F.lit(0)).alias("r")).where("r.meta is not null")
    price, before = F.col("r.meta.regularMarketPrice"), F.coalesce("r.meta.chartPreviousClose", "r.meta.previousClose")
    pairs = F.arrays_zip(F.col("r.timestamp").alias("t"), F.get("r.indicators.quote", F.lit(0))["close"].alias("c"))
    closes = F.transform(F.filter(pairs, lambda p: p["t"].isNotNull() & p["c"].isNotNull()), lambda p: F.struct(F.date_format(F.timestamp_seconds(p["t"]), "yyyy-MM-dd").alias("date"), p["c"].alias("close")))
    return own.select(
        "key",
        F.coalesce("r.meta.symbol", F.upper("key")).alias("symbol"),
        F.coalesce("r.meta.longName", "r.meta.shortName").alias("name"),
        F.col("r.meta.currency").alias("currency"),
        price.alias("price"),
        before.alias("previous_close"),
        F.round(price - before, 4).alias("change"),
        F.when(before != 0, F.round((price - before) / before * 100, 3)).alias("change_pct"),
        F.timestamp_seconds("r.meta.regularMarketTime").alias("observed_at"),
        F.coalesce(closes, F.array().cast("array<struct<date:string,close:double>>")).alias("closes"),
    )


def indicator(answers: DataFrame) -> DataFrame:
    """(key, indicator, country, year, value, is_latest) of known indicators; answers also have `indicator`. Years without a value are left out; the first that has one is the latest."""
    codes = F.create_map(*[F.lit(v) for name, code, _ in INDICATORS for v in (name, code)])
    own = answers.where(F.col("status").between(200, 299) & F.try_element_at(codes, F.col("indicator")).isNotNull())
    rows = F.from_json(F.get(F.from_json("body", "array<string>"), F.lit(1)), "array<struct<date:string,value:double,country:struct<value:string>>>")
    own = own.select("key", "indicator", F.posexplode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("i", "r"))
    return own.select("key", "indicator", F.coalesce("r.country.value", F.upper("key")).alias("country"), F.col("r.date").alias("year"), F.col("r.value").alias("value"), (F.col("i") == 0).alias("is_latest"))


def with_population(countries: DataFrame, series: DataFrame) -> DataFrame:
    """countries (code, ...) with the latest population where there is one: a country without a series is still a country."""
    latest = series.where("indicator = 'population' and is_latest").select(F.col("key").alias("_k"), F.col("year").alias("population_year"), F.col("value").alias("population"))
    return countries.join(latest, F.lower("code") == F.lower("_k"), "left").drop("_k")


def plain_name(x: Column) -> Column:
    """A name by which places are compared: small letters and digits, Turkish letters as their Latin ones."""
    return F.regexp_replace(F.lower(F.translate(x, *LETTERS)), "[^a-z0-9]", "")
