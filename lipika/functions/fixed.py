"""Names, tables and patterns that results depend on, stated as they are."""

from __future__ import annotations

# Structural works and the prefix of their verse ids.
WORK_PREFIX = {"rigveda": "RV", "bhagavad-gita": "BG", "yoga-sutra": "YS", "yajurveda": "VS", "atharvaveda": "AV", "samaveda": "SV"}

# Devanagari letters and their IAST spelling.
VOWELS = {"अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ", "ऌ": "ḷ", "ॡ": "ḹ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
VOWEL_SIGNS = {"ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ", "ॢ": "ḷ", "ॣ": "ḹ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "ś", "ष": "ṣ", "स": "s", "ह": "h",
}
SIGNS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "ॐ": "om", "।": ".", "॥": ".."}
VIRAMA = "्"

# IAST letters and the ASCII letter each folds to (Ṹ where one expects Ḹ: results depend on it).
IAST_LETTERS = "āīūṛṝḷḹṃḥśṣñṅṭḍṇĀĪŪṚṜḶṸṂḤŚṢÑṄṬḌṆ"
ASCII_LETTERS = "aiurrllmhssnntdnAIURRLLMHSSNNTDN"
# Common respellings, in order.
PHONETIC = (("ś", "sh"), ("ṣ", "sh"), ("ṛ", "ri"), ("c", "ch"), ("v", "w"))

# Equivalents a query term also stands for.
EXPANSIONS = {
    "self": ["atman", "ātman", "atma", "purusha", "soul"],
    "atman": ["self", "ātman", "soul", "purusha"],
    "brahman": ["absolute", "imperishable", "brahma", "supreme"],
    "dharma": ["duty", "righteousness", "law", "rita", "ṛta"],
    "karma": ["action", "work", "deed"],
    "yoga": ["union", "discipline", "samadhi", "meditation"],
    "bhakti": ["devotion", "love", "worship"],
    "jnana": ["knowledge", "wisdom", "vidya"],
    "moksha": ["liberation", "release", "kaivalya", "freedom"],
    "krishna": ["vasudeva", "madhava", "lord", "bhagavan"],
    "rama": ["raghava", "dasharathi"],
    "agni": ["fire", "priest of sacrifice"],
    "indra": ["vritra", "vajra"],
    "om": ["aum", "pranava", "ॐ"],
    "aum": ["om", "pranava", "ॐ"],
    "gita": ["bhagavad", "bhagavad-gita", "song"],
    "upanishad": ["vedanta", "aranyaka"],
    "veda": ["rig", "rigveda", "yajur", "sama", "atharva"],
    "purusha": ["person", "cosmic person", "self"],
    "ishvara": ["lord", "god", "isvara"],
    "samadhi": ["absorption", "yoga", "meditation"],
    "ahimsa": ["non-injury", "nonviolence"],
    "samsara": ["cycle", "rebirth", "becoming"],
}

# Hymns by name in a query, and the names distinctive enough to be sought in a text.
NAMED_HYMNS = (
    ("n[aā]sad[iī]ya|नासदीय|नासदासीन्", "10.129"),
    (r"puru[sṣś]h?a\s+s[uū]kta|\bpurusha\s+sukta|\bpurusa\s+sukta", "10.90"),
    ("g[aā]yat(?:h)?r[iī]|गायत्री", "3.62"),
    (r"tatsavitur|tat\s*savitur|तत्\s*सवितुर्", "3.62"),
    ("hira[nṇ]yagarbha|हिरण्यगर्भ", "10.121"),
    (r"\bv[aā][kcç]\s+s[uū]kta|\bvak\s+sukta|\bvac\s+sukta|\bv[aā]k\b|\bvāc\b|वाक्\s*सूक्त|वाच्\s*सूक्त|वाक\s*सूक्त|वाक्सूक्त", "10.125"),
)
NAMES_IN_TEXT = {"10.129": NAMED_HYMNS[0][0], "10.90": NAMED_HYMNS[1][0]}
EXPLICIT_HYMN = r"(?:(?:\brv\b|ṛgveda|rigveda|rig\s*veda|hymn|s[uū]kta)\s*)(\d{1,2}\.\d{1,3})|\b(\d{1,2}\.\d{1,3})\b"
ROMAN_BOOKS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")

# Works by name in a query, in order of precedence.
NAMED_WORKS = (
    ("ī[sś]āvāsy|[iī]sha?v[aā]sy|isavasy|ईशावास्य", "isha-upanishad"),
    (r"\b[iī][sśṣ]h?[aā]\s*upani[sṣś]h?ad|\bisa\s+upanishad|ishavasyopanishad|ईशावास्योपनिष", "isha-upanishad"),
    ("nachiketas?|n[aā]ciketas?|नचिकेत", "katha-upanishad"),
    (r"\bka[tṭ]ha\s*upani[sṣś]h?ad|कठोपनिष", "katha-upanishad"),
    (r"s[aā]ma\s*[- ]?\s*veda|s[aā]maveda|सामवेद", "samaveda"),
    (r"shukla\s+yajur|śukla\s+yajur|white\s+yajur|v[aā]jasaneyi|vajasneyi|yajurveda\s+vs\b|yajur\s+veda\s+vs\b|शुक्ल\s*यजुर्|वाजसनेयि", "yajurveda-vs"),
    ("b[rṛ]i?had[aā]ra[nṇ]yaka|बृहदारण्यक", "brihadaranyaka-upanishad"),
    (r"\bneti[\s\-]*neti\b|नेति[\s\-]*नेति", "brihadaranyaka-upanishad"),
    ("m[aā][nṇ][dḍ][uū]kya|माण्डूक्य|मांडूक्य", "mandukya-upanishad"),
    (
        r"(?:\bs[iī]t[aā]\b|सीता).{0,80}(?:abduct|kidnap|r[aā]va[nṇ]a|रावण|rapto|raptad)|(?:abduct|kidnap|r[aā]va[nṇ]a|रावण|rapto|raptad).{0,80}(?:\bs[iī]t[aā]\b|सीता)",
        "ramayana",
    ),
    ("r[aā]m[aā]ya[nṇ]|रामायण|v[aā]lm[iī]ki|वाल्मीकि", "ramayana"),
    (r"yoga.?s[uū]tra|yogasutra|pata[nñ]jali|patañjali|योगसूत्र|पतञ्जलि|yogaś\s+citta|citta.?v[rṛ]tti.?nirodha", "yoga-sutra"),
    (r"defini(?:tion|ção|cao|çao|cão)\s+(?:of\s+|de\s+|do\s+)?yoga|yoga\s+defini(?:tion|ção|cao|çao|cão)|o\s+que\s+[eé]\s+(?:o\s+)?yoga", "yoga-sutra"),
)

# Per work the metadata that names it, that rules it out, and that is preferred.
WORK_RULES = {
    "isha-upanishad": (
        r"ishavasy|īśāvāsy|ईशावास्य|\b[iī][sśṣ]h?[aā]\s*upani[sṣś]h?ad|\bisa\s+upanishad|\bisha\b|īśā",
        r"\brigveda\b|\brig\s*veda\b|\brv\s+\d",
        r"upani[sṣś]h?ad|ईशावास्य|\bisha\b|īśā",
    ),
    "katha-upanishad": (r"\bka[tṭ]ha\s*upani[sṣś]h?ad|\bka[tṭ]ha\b|कठोपनिष|कठ", "chandogya|chāndogya|kaushitaki|kau[sṣ][iī]taki|kausitaki", "upani[sṣś]h?ad|कठ"),
    "samaveda": (r"s[aā]maveda\s+sv\b|\bs[aā]ma[- ]?veda\b|सामवेद|\bsv\s+\d", "chandogya|chāndogya|upanishad|upani[sṣ]ad|antholog", r"s[aā]maveda\s+sv\b|\bsv\s+\d"),
    "yajurveda-vs": (
        r"yajurveda\s+vs\b|yajur\s+veda\s+vs\b|\bvs\s+\d|v[aā]jasaneyi|vajasneyi|shukla\s+yajur|white\s+yajur|शुक्ल\s*यजुर्|वाजसनेयि",
        r"müller|muller|upanishad|upani[sṣ]ad|antholog|krishna\s+yajur|kṛṣṇa\s+yajur",
        r"yajurveda\s+vs\b|\bvs\s+\d|v[aā]jasaneyi|vajasneyi",
    ),
    "brihadaranyaka-upanishad": ("b[rṛ]i?had[aā]ra[nṇ]yaka|बृहदारण्यक", r"principal\s+upanishads|english\s+core|antholog|selected\s+hymns|markandeya|mārkaṇḍeya", "b[rṛ]i?had[aā]ra[nṇ]yaka|बृहदारण्यक"),
    "mandukya-upanishad": ("m[aā][nṇ][dḍ][uū]kya|माण्डूक्य|मांडूक्य", r"principal\s+upanishads|english\s+core|antholog|selected\s+hymns|mu[nṇ][dḍ]aka|मुण्डक", "m[aā][nṇ][dḍ][uū]kya|माण्डूक्य"),
    "ramayana": ("r[aā]m[aā]ya[nṇ]|रामायण|v[aā]lm[iī]ki|वाल्मीकि", "mahabharata|mahābhārata|ganguli|bhishma|bhīṣma|kurukshetra", "r[aā]m[aā]ya[nṇ]|v[aā]lm[iī]ki|रामायण"),
    "yoga-sutra": (
        "yoga.?s[uū]tra|yogasutra|pata[nñ]jali|patañjali|योगसूत्र|पतञ्जलि",
        r"markandeya|mārkaṇḍeya|pur[aā][nṇ]a|mah[aā]bh[aā]rata|upanishad|upani[sṣ]ad|selected\s+hymns|antholog",
        "yoga.?s[uū]tra|yogasutra|pata[nñ]jali",
    ),
}
ANTHOLOGY = r"selected\s+hymns|principal\s+upanishads|thirteen\s+principal|english\s+core|antholog|selected\s+(?:upanishads|verses|texts|suktas)|(?:^|\s)the\s+upanishads\s*[\(:]|vedic\s+antholog"
EPIC_TITLE = "mahabharata|mahābhārata|ramayan|rāmāyaṇ|ganguli|valmiki|vālmīki"
HYMN_TITLE = r"rigveda\s+rv\s+\d|rig\s*veda|sukta|sūkta|upanishad|upaniṣad|g[iī]t[aā]|yoga.?s[uū]tra"
EPIC_HINTS = (
    "mahabharata", "mahābhārata", "ramayana", "rāmāyaṇa", "rama", "rāma", "sita", "sītā", "arjuna", "krishna", "kṛṣṇa", "bhishma", "bhīṣma",
    "kurukshetra", "pandava", "kaurava", "hanuman", "lakshmana", "valmiki", "ganguli",
)
DEITY = {"agni": r"\bagni\b|अग्नि"}
DEITY_TITLE = {"agni": r"(?:rigveda|ṛgveda|rig\s*veda|\brv\s+\d).{0,120}\bagni\b|\bagni\b.{0,120}(?:rigveda|ṛgveda|rig\s*veda|\brv\s+\d)"}
DEITY_EXTRA = ("fire", "god", "deity", "deva", "devata", "hymn", "sukta", "sūkta")

# Boosts, fusion weights and caps of the hybrid score.
SEMANTIC_WEIGHT, BM25_K1, BM25_B = 0.65, 1.5, 0.75
HYMN_TITLE_BOOST, HYMN_TEXT_BOOST, WORK_BOOST, DEITY_BOOST, PHRASE_BOOST, ANTHOLOGY_DEMOTION = 1.45, 1.05, 1.45, 1.05, 1.25, 1.35
OVERLAP_BOOST, HYMN_NAME_BOOST, SHORT_BOOST, LONG_PENALTY, EPIC_PENALTY = 0.14, 0.07, 0.04, 0.03, 0.08
INJECTIONS, PER_DOCUMENT = 4, 2

# Phrases of one verse translation that mark a verse, by chapter.
VERSE_PHRASES = {
    2: ((11, "thou grievest where no grief should be"), (12, "nor i, nor thou, nor any one of these"), (13, "infancy and youth and age"), (19, "lo! i have slain a man"), (20, "never the spirit was born"), (22, "as when one layeth"), (23, "weapons reach not the life"), (47, "let right deeds be")),
    3: ((4, "no man shall 'scape from act"), (5, "no jot of time, at any time"), (8, "work is more excellent than idleness"), (19, "thy task prescribed"), (21, "what the wise choose"), (35, "this is better, that one do")),
    4: ((7, "when righteousness"), (8, "succouring the good"), (37, "the flame of knowledge wastes")),
    6: ((16, "too much fasts"), (17, "moderate in eating"), (19, "a lamp burns sheltered from the wind")),
    9: ((26, "leaf, a flower, a fruit"),),
    18: ((66, "fly unto me"), (78, "where krishna is")),
}
# Hymns in each of the ten books of the Rigveda.
HYMNS_PER_BOOK = (191, 43, 62, 58, 87, 75, 104, 103, 114, 191)

# The public collections that structured payloads come from; titles, addresses and credits of their records.
COLLECTION_URL = "https://github.com/bhavykhatri/DharmicData"
SHEET_URL = "https://github.com/VedaWebProject/vedaweb-data/blob/main/rigveda/versions/zurich.xlsx"
COLLECTION_ATTRIBUTION = "Contains information from DharmicData (https://github.com/bhavykhatri/DharmicData), available under the Open Database License (ODbL). Sanskrit slokas/mantras only; modern commentaries and translations omitted."
COLLECTION_SANSKRIT, COLLECTION_GRIFFITH, COLLECTION_HEADING, SAMHITA = "Sanskrit, DharmicData", "Griffith, DharmicData", "Sanskrit (DharmicData)", "vajasaneyi-madhyandina"
PAYLOAD_TITLES = {"bhagavad-gita": "Bhagavad-gītā ", "rigveda": "Rigveda RV ", "yajurveda": "Yajurveda VS ", "atharvaveda": "Atharvaveda AV ", "samaveda": "Sāmaveda SV "}

# Classes of sources that are read in a way of their own, the portal's licence, a title where a page has none.
PORTAL_CLASS, STRUCTURED_CLASS, PORTAL_LICENSE, PORTAL_TITLE = "vedicheritage", "structured-json", "gov-ind", "Vedic Heritage text"
