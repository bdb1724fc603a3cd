"""Fixed values that results depend on: word lists, patterns and tables, in their natural order."""

from __future__ import annotations

# fixed values: sentiment, emotions
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "perfect", "love", "like", "happy", "pleased", "satisfied"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "hate", "dislike", "angry", "sad", "disappointed", "frustrated", "annoyed", "upset"]
EMOTIONS = {
    "joy": ["happy", "joy", "excited", "pleased", "delighted", "cheerful", "glad", "elated"],
    "anger": ["angry", "mad", "furious", "rage", "annoyed", "frustrated", "irritated"],
    "sadness": ["sad", "depressed", "unhappy", "grief", "sorrow", "melancholy", "down"],
    "fear": ["afraid", "scared", "terrified", "anxious", "worried", "nervous", "fearful"],
    "surprise": ["surprised", "amazed", "shocked", "astonished", "stunned", "startled"],
    "disgust": ["disgusted", "revolted", "repulsed", "sickened", "appalled"],
    "trust": ["trust", "confident", "secure", "certain", "assured", "reliable"],
    "anticipation": ["excited", "eager", "looking forward", "anticipating", "expecting"],
}

# fixed values: boilerplate phrases
BOILERPLATE = ["cookie", "privacy policy", "terms of service", "subscribe to", "newsletter", "follow us", "share this", "related articles", "read more", "advertisement", "sponsored", "copyright", "all rights reserved"]

# fixed values: stop words by language, in the order in which ties are decided
STOP_WORDS = {
    "en": ["the", "and", "is", "in", "to", "of", "a", "that", "it", "with", "for", "as", "was", "on", "are", "you"],
    "es": ["el", "la", "de", "que", "y", "en", "un", "es", "se", "no", "te", "lo", "le", "da", "su", "por", "son"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "et", "en", "avoir", "que", "pour", "dans", "ce", "son", "une"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im"],
    "it": ["il", "di", "che", "e", "la", "per", "in", "un", "è", "da", "sono", "con", "non", "si", "una", "su"],
}

# fixed values: character ranges of scripts, right-to-left first
SCRIPTS_RTL = {"arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]", "hebrew": r"[\x{0590}-\x{05FF}]", "persian": r"[\x{06A0}-\x{06EF}]"}
SCRIPTS_CJK = {"chinese": r"[\x{4E00}-\x{9FFF}]", "japanese": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]", "korean": r"[\x{AC00}-\x{D7AF}]"}

# fixed values: signs of a country in a text
CURRENCIES = {
    "$": (["$", "USD", "CAD", "AUD"], None),
    "€": (["€", "EUR"], None),
    "£": (["£", "GBP"], "GB"),
    "¥": (["¥", "JPY", "CNY", "￥"], None),
    "₹": (["₹", "INR"], "IN"),
    "₽": (["₽", "RUB"], "RU"),
    "₩": (["₩", "KRW"], "KR"),
    "﷼": (["﷼", "SAR"], "SA"),
}
PHONES = {
    "US": r"\+1[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}",
    "GB": r"\+44[\s.-]?\d{2,4}[\s.-]?\d{6,8}",
    "DE": r"\+49[\s.-]?\d{2,4}[\s.-]?\d{6,8}",
    "FR": r"\+33[\s.-]?\d{1}[\s.-]?\d{8}",
}
DATES = {"US": r"\d{1,2}/\d{1,2}/\d{4}", "GB": r"\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}", "DE": r"\d{1,2}\.\d{1,2}\.\d{4}", "JP": r"\d{4}/\d{1,2}/\d{1,2}"}
METRIC, IMPERIAL = r"(?i)\d+\s*(cm|mm|km|kg|celsius|°C)", r"(?i)\d+\s*(inch|foot|feet|yard|mile|pound|fahrenheit|°F)"

# fixed values: topic categories, the first that fits wins
TOPICS = {
    "technology": ["technology", "software", "computer", "digital", "internet", "app", "system", "data", "code", "development"],
    "business": ["business", "company", "market", "sales", "revenue", "profit", "customer", "service", "management", "strategy"],
    "science": ["science", "research", "study", "analysis", "experiment", "theory", "discovery", "scientific", "academic"],
    "health": ["health", "medical", "disease", "treatment", "patient", "doctor", "medicine", "hospital", "therapy", "care"],
    "politics": ["politics", "government", "policy", "election", "politician", "vote", "democracy", "law", "congress", "president"],
    "sports": ["sports", "game", "team", "player", "match", "competition", "championship", "athletic", "training", "coach"],
    "entertainment": ["movie", "music", "entertainment", "film", "show", "celebrity", "actor", "artist", "performance", "media"],
    "education": ["education", "school", "student", "teacher", "university", "learning", "course", "academic", "knowledge", "study"],
}
KEYWORD_KINDS = {
    "technical": ["api", "sdk", "framework", "library", "database", "algorithm", "protocol", "server", "client", "interface"],
    "business": ["revenue", "profit", "market", "customer", "client", "sales", "business", "company", "organization"],
    "academic": ["research", "study", "analysis", "theory", "method", "approach", "findings", "results", "conclusion"],
    "temporal": ["year", "month", "week", "day", "time", "period", "date", "today", "yesterday", "tomorrow"],
    "geographical": ["country", "city", "state", "region", "area", "location", "place", "world", "global", "international"],
}

# fixed values: authority of sites
AUTHORITY = {"wikipedia.org": 1.0, "github.com": 0.9, "stackoverflow.com": 0.9, "mozilla.org": 0.8, "w3.org": 0.8}
AUTHORITY_BY_ENDING = {".edu": 0.8, ".gov": 0.9, ".org": 0.6, ".com": 0.4}

# fixed values: pairs of words that contradict
ANTONYMS = [("not", "is"), ("false", "true"), ("incorrect", "correct"), ("impossible", "possible"), ("never", "always"), ("no", "yes")]

# fixed values: hosts by kind of source
BLOG_HOSTS = ["medium.com", "blogspot.com", "wordpress.com", "substack.com"]
NEWS_HOSTS = ["reuters.com", "apnews.com", "bbc.com", "nytimes.com", "cnn.com"]

# fixed values: levels of change, lowest first
LEVELS = ["none", "minor", "moderate", "major", "critical"]

# fixed values: suffix, replacement, least length of the word
STEM_RULES = [("ies", "y", 4), ("ied", "y", 4), ("ing", "", 4), ("ed", "", 3), ("s", "", 3), ("ly", "", 4), ("er", "", 3), ("est", "", 4)]

# fixed values: path parts of site sections, the first that fits wins
SECTIONS = {
    "content": ["/blog", "/news", "/articles", "/posts"],
    "navigation": ["/about", "/contact", "/help", "/support"],
    "media": ["/images", "/media", "/gallery", "/downloads"],
    "tools": ["/tools", "/utilities", "/calculator", "/converter"],
    "documentation": ["/docs", "/documentation", "/api", "/guide"],
}
MEDIA_FILES = ["jpg", "jpeg", "png", "gif", "svg", "mp4", "mp3"]
DOCUMENT_FILES = ["pdf", "doc", "docx", "txt", "csv", "xml"]

# fixed values: upper bounds of latency buckets in milliseconds
LATENCY_BOUNDS = [10, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000]

# fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "ave", "blvd", "vs", "etc", "inc", "ltd", "corp", "dept", "univ", "assn", "approx", "appt", "apt", "est", "min", "max", "govt", "lib", "misc", "natl", "intl", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun", "fig", "eq", "ref", "vol", "no", "pp", "ed", "rev", "e", "i"]
