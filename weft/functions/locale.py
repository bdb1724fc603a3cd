"""Countries and what goes with them: fixed values and their Column lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urls

# fixed values: country, time zone, currency, language, search domain, right-to-left, name, date format
COUNTRIES = [
    ("US", "America/New_York", "USD", "en-US", "google.com", False, "MM/DD/YYYY", "United States"),
    ("GB", "Europe/London", "GBP", "en-GB", "google.co.uk", False, "DD/MM/YYYY", "United Kingdom"),
    ("DE", "Europe/Berlin", "EUR", "de-DE", "google.de", False, "DD.MM.YYYY", "Germany"),
    ("FR", "Europe/Paris", "EUR", "fr-FR", "google.fr", False, "DD/MM/YYYY", "France"),
    ("JP", "Asia/Tokyo", "JPY", "ja-JP", "google.co.jp", False, "YYYY/MM/DD", "Japan"),
    ("CN", "Asia/Shanghai", "CNY", "zh-CN", "baidu.com", False, "YYYY/MM/DD", "China"),
    ("AU", "Australia/Sydney", "AUD", "en-AU", "google.com.au", False, "DD/MM/YYYY", "Australia"),
    ("CA", "America/Toronto", "CAD", "en-CA", "google.ca", False, "YYYY-MM-DD", "Canada"),
    ("IT", "Europe/Rome", "EUR", "it-IT", "google.it", False, "DD/MM/YYYY", "Italy"),
    ("ES", "Europe/Madrid", "EUR", "es-ES", "google.es", False, "DD/MM/YYYY", "Spain"),
    ("RU", "Europe/Moscow", "RUB", "ru-RU", "yandex.ru", False, "DD.MM.YYYY", "Russia"),
    ("BR", "America/Sao_Paulo", "BRL", "pt-BR", "google.com.br", False, "DD/MM/YYYY", "Brazil"),
    ("IN", "Asia/Kolkata", "INR", "hi-IN", "google.co.in", False, "DD/MM/YYYY", "India"),
    ("KR", "Asia/Seoul", "KRW", "ko-KR", "google.co.kr", False, "YYYY.MM.DD", "South Korea"),
    ("MX", "America/Mexico_City", "MXN", "es-MX", "google.com.mx", False, "DD/MM/YYYY", "Mexico"),
    ("NL", "Europe/Amsterdam", "EUR", "nl-NL", "google.nl", False, "DD-MM-YYYY", "Netherlands"),
    ("SE", "Europe/Stockholm", "SEK", "sv-SE", "google.se", False, "YYYY-MM-DD", "Sweden"),
    ("NO", "Europe/Oslo", "NOK", "nb-NO", "google.no", False, "DD.MM.YYYY", "Norway"),
    ("SA", "Asia/Riyadh", "SAR", "ar-SA", "google.com.sa", True, "DD/MM/YYYY", "Saudi Arabia"),
    ("AE", "Asia/Dubai", "AED", "ar-AE", "google.ae", True, "DD/MM/YYYY", "United Arab Emirates"),
    ("TR", "Europe/Istanbul", "TRY", "tr-TR", "google.com.tr", False, "DD.MM.YYYY", "Turkey"),
    ("IL", "Asia/Jerusalem", "ILS", "he-IL", "google.co.il", True, "DD.MM.YYYY", "Israel"),
    ("TH", "Asia/Bangkok", "THB", "th-TH", "google.co.th", False, "DD/MM/YYYY", "Thailand"),
    ("SG", "Asia/Singapore", "SGD", "en-SG", "google.com.sg", False, "DD/MM/YYYY", "Singapore"),
    ("PL", "Europe/Warsaw", "PLN", "pl-PL", "google.pl", False, "DD.MM.YYYY", "Poland"),
    ("ZA", "Africa/Johannesburg", "ZAR", "en-ZA", "google.co.za", False, "YYYY/MM/DD", "South Africa"),
]
NUMBER_FORMATS = {"US": "1,234.56", "GB": "1,234.56", "DE": "1.234,56", "FR": "1 234,56"}
FIRST_DAYS = {"US": 0, "GB": 1, "DE": 1, "FR": 1}
DATE_RESTRICT = {"day": "d1", "week": "w1", "month": "m1", "year": "y1"}


def rows() -> list[tuple]:
    return list(COUNTRIES)


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "country string, time_zone string, currency string, language string, search_domain string, rtl boolean, date_format string, name string")


def lookup(key: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def date_format(country: Column) -> Column:
    return lookup(country, {r[0]: r[6] for r in rows()}, "DD/MM/YYYY")


def number_format(country: Column) -> Column:
    return lookup(country, NUMBER_FORMATS, "1,234.56")


def first_day_of_week(country: Column) -> Column:
    return lookup(country, FIRST_DAYS, 1)


def date_restrict(period: Column) -> Column:
    return lookup(period, DATE_RESTRICT, None)


def country_of(url: Column) -> Column:
    """Supported country of a two-letter top-level domain, else null."""
    tld = F.upper(F.regexp_extract(urls.host(url), r"\.([a-z]{2})$", 1))
    return F.when(tld.isin(*(r[0] for r in rows())), tld)
