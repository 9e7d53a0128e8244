"""Place names, and a generated alternation of them, the longest first."""

from __future__ import annotations

import re

COUNTRIES = """
Afghanistan Albania Algeria Argentina Armenia Australia Austria Azerbaijan Bahrain Bangladesh Belarus Belgium Bolivia Bosnia Brazil Bulgaria
Cambodia Cameroon Canada Chile China Colombia Croatia Cuba Cyprus Czechia Denmark Ecuador Egypt Estonia Ethiopia Finland France Georgia Germany
Ghana Greece Hungary Iceland India Indonesia Iran Iraq Ireland Israel Italy Japan Jordan Kazakhstan Kenya Kuwait Latvia Lebanon Libya Lithuania
Luxembourg Malaysia Malta Mexico Moldova Mongolia Morocco Nepal Netherlands Nigeria Norway Pakistan Panama Paraguay Peru Philippines Poland
Portugal Qatar Romania Russia Rwanda Serbia Singapore Slovakia Slovenia Somalia Spain Sudan Sweden Switzerland Syria Taiwan Tanzania Thailand
Tunisia Turkey Uganda Ukraine Uruguay Venezuela Vietnam Yemen Zambia Zimbabwe
""".split()
CITIES = """
London Paris Berlin Madrid Rome Vienna Graz Linz Salzburg Zurich Zürich Geneva Munich Hamburg Frankfurt Cologne Amsterdam Rotterdam Brussels
Antwerp Lisbon Barcelona Milan Turin Naples Venice Florence Athens Warsaw Krakow Kraków Prague Budapest Bucharest Sofia Belgrade Zagreb
Ljubljana Bratislava Copenhagen Stockholm Oslo Helsinki Dublin Edinburgh Glasgow Manchester Birmingham Liverpool Lyon Marseille Nice Moscow
Petersburg Kyiv Istanbul Ankara Cairo Nairobi Lagos Johannesburg Casablanca Dubai Doha Riyadh Tehran Baghdad Jerusalem Beirut Delhi Mumbai
Bangalore Karachi Dhaka Bangkok Jakarta Manila Beijing Shanghai Shenzhen Guangzhou Seoul Tokyo Osaka Kyoto Sydney Melbourne Auckland Toronto
Montreal Vancouver Ottawa Chicago Boston Seattle Denver Atlanta Miami Dallas Houston Phoenix Detroit Philadelphia Washington Portland Anytown
""".split()
LONGER = (
    "United States,United Kingdom,United Arab Emirates,South Africa,South Korea,North Korea,New Zealand,Saudi Arabia,Sri Lanka,Costa Rica,"
    "Czech Republic,Hong Kong,El Salvador,New York,Los Angeles,San Francisco,San Diego,Las Vegas,New Orleans,Cape Town,Rio de Janeiro,Sao Paulo,"
    "São Paulo,Buenos Aires,Mexico City,Kuala Lumpur,Abu Dhabi,St. Petersburg,Tel Aviv"
).split(",")

PLACES = tuple(dict.fromkeys([*COUNTRIES, *CITIES, *LONGER]))
PLACE_WORDS = frozenset(w.lower() for w in (*COUNTRIES, *CITIES))


def alternation(places=PLACES) -> str:
    """Pattern of the places as whole words."""
    return r"(?<!\w)(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(places, key=lambda p: (-len(p), p))) + r")(?!\w)"
