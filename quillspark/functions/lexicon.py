"""Word lists of the rule-based extraction, as data; every function takes another lexicon in place of the default."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values, in natural order: the lists below must equal those of the domain for right results.
STOPWORDS = (
    "aku", "ada", "adalah", "agar", "akan", "atau", "badan", "bagaimana", "bagi", "bisa", "dan", "dengan", "di", "diderita", "ini", "itu", "jadi",
    "juga", "kalau", "karena", "ke", "keluhan", "kena", "lagi", "mau", "mengalami", "mohon", "nya", "obat", "pada", "rekomendasi", "saya", "sedang",
    "sejak", "sudah", "tapi", "terasa", "tidak", "tolong", "untuk", "yang",
)
SYNONYMS = {
    "kerongkongan": "tenggorokan", "radang": "nyeri", "sakit": "nyeri", "gatal": "iritasi", "mulas": "diare", "mencret": "diare", "bab": "diare",
    "cair": "diare", "enek": "mual", "eneg": "mual", "masuk": "kurang", "angin": "fit", "capek": "lelah", "lesu": "lelah", "malas": "nafsu",
    "selera": "nafsu", "makan": "makan", "panas": "demam", "meriang": "demam",
}
NEGATIONS = ("tidak ada", "tidak", "tanpa", "nggak", "gak", "ga", "bukan")
CLEARANCES = ("tidak ada", "tanpa", "tidak", "nggak", "gak", "ga")
RED_FLAGS = {
    "demam tinggi": "demam tinggi", "sesak": "sesak napas", "susah napas": "sesak napas", "sulit napas": "sesak napas",
    "sulit menelan": "sulit menelan berat", "menelan berat": "sulit menelan berat", "diare berdarah": "diare berdarah",
    "bab berdarah": "diare berdarah", "darah": "perdarahan atau darah pada keluhan", "dehidrasi": "tanda dehidrasi",
    "lemas sekali": "lemas berat", "muntah terus": "muntah terus-menerus", "muntah terus-menerus": "muntah terus-menerus",
    "nyeri hebat": "nyeri hebat", "nyeri perut hebat": "nyeri perut hebat", "nyeri dada": "nyeri dada", "kejang": "kejang",
    "pingsan": "pingsan", "penurunan kesadaran": "penurunan kesadaran", "kaku leher": "kaku leher",
    "gangguan penglihatan": "gangguan penglihatan", "penglihatan kabur": "gangguan penglihatan",
    "pandangan kabur": "gangguan penglihatan", "bicara pelo": "kesulitan berbicara", "kesulitan berbicara": "kesulitan berbicara",
    "sulit berbicara": "kesulitan berbicara", "mati rasa": "mati rasa", "kelemahan satu sisi": "kelemahan satu sisi tubuh",
    "lemah satu sisi": "kelemahan satu sisi tubuh", "muntah darah": "muntah darah", "tinja hitam": "tinja hitam",
    "bab hitam": "tinja hitam", "batuk darah": "batuk darah", "berat badan turun": "penurunan berat badan",
    "turun berat badan": "penurunan berat badan", "keringat malam": "keringat malam", "batuk 3 minggu": "batuk lebih dari 3 minggu",
    "batuk lebih dari 3 minggu": "batuk lebih dari 3 minggu", "batuk lebih 3 minggu": "batuk lebih dari 3 minggu",
    "perdarahan rektum": "perdarahan rektum", "ruam berdarah": "ruam/perdarahan kulit",
    "bintik merah tidak hilang": "ruam/perdarahan kulit", "kulit melepuh": "ruam melepuh", "ruam melepuh": "ruam melepuh",
    "lepuh": "ruam melepuh", "bengkak wajah": "reaksi alergi berat", "wajah bengkak": "reaksi alergi berat",
    "bibir bengkak": "reaksi alergi berat", "lidah bengkak": "reaksi alergi berat", "tenggorokan bengkak": "reaksi alergi berat",
    "urin gelap": "urin gelap", "urine gelap": "urin gelap", "urine berdarah": "urine berdarah", "kencing berdarah": "urine berdarah",
    "air kencing berdarah": "urine berdarah", "mata kuning": "mata/kulit kuning", "kulit kuning": "mata/kulit kuning",
    "bercak mati rasa": "bercak kulit mati rasa", "kulit mati rasa": "bercak kulit mati rasa", "luka tidak nyeri": "luka tanpa nyeri",
    "kaki membengkak": "pembengkakan tungkai", "tungkai membengkak": "pembengkakan tungkai", "pembengkakan kaki": "pembengkakan tungkai",
    "hamil": "kehamilan perlu kehati-hatian khusus", "bayi": "keluhan pada bayi perlu evaluasi tenaga kesehatan",
}
CASE_HINTS = {
    "case_001": ("mual", "muntah", "enek", "eneg", "lambung", "maag", "ulu hati", "nyeri ulu hati", "perih lambung", "asam lambung", "sendawa"),
    "case_002": ("tenggorokan", "gatal tenggorokan", "sakit tenggorokan"),
    "case_003": ("nafsu makan", "malas makan", "tidak nafsu", "selera makan"),
    "case_004": ("pegal", "kurang fit", "capek", "lelah", "badan pegal"),
    "case_005": ("diare", "mencret", "bab cair", "perut mulas"),
    "case_006": ("panas badan", "demam", "demam ringan", "tidak nyaman tubuh", "nyeri ringan", "meriang", "meriang ringan", "pusing", "pusing ringan", "sakit kepala", "sakit kepala ringan"),
    "case_007": ("batuk ringan", "suara serak", "serak", "polusi"),
    "case_008": ("batuk pilek", "pilek ringan", "hidung meler", "batuk"),
    "case_009": ("gatal", "gatal-gatal", "gatal gatal", "ruam", "ruam merah", "bentol", "biduran", "alergi kulit"),
}
SYMPTOMS = {
    "demam": ("demam", "panas badan", "meriang", "badan panas"),
    "sakit kepala": ("sakit kepala", "kepala sakit", "pusing", "kepala pusing", "kunang kunang"),
    "batuk": ("batuk",),
    "pilek": ("pilek", "hidung meler", "ingusan"),
    "sakit tenggorokan": ("sakit tenggorokan", "tenggorokan", "gatal tenggorokan"),
    "sesak napas": ("sesak", "sesak napas", "susah napas", "sulit napas"),
    "mual": ("mual", "enek", "eneg"),
    "muntah": ("muntah",),
    "diare": ("diare", "mencret", "bab cair"),
    "nyeri perut": ("nyeri perut", "perut sakit", "mulas", "nyeri ulu hati", "ulu hati"),
    "ruam": ("ruam", "ruam merah", "bintik merah", "bentol", "biduran"),
    "gatal": ("gatal", "gatal gatal", "gatal-gatal"),
    "nyeri otot/sendi": ("nyeri otot", "nyeri sendi", "pegal", "badan pegal"),
    "lemas": ("lemas", "lemas sekali", "lesu", "lelah", "capek"),
    "bengkak": ("bengkak", "bengkak wajah", "bibir bengkak", "lidah bengkak"),
    "perdarahan": ("darah", "perdarahan", "mimisan", "gusi berdarah", "bab hitam", "tinja hitam"),
}
DURATIONS = (
    r"\b(?:sudah|selama|sejak|baru|sekitar|kurang lebih)\s+(?:[a-z]+\s+){0,3}?\d+\s*(?:jam|hari|minggu|bulan)\b",
    r"\b(?:sudah|selama|sejak|baru)\s+(?:tadi\s+(?:pagi|siang|sore|malam)|kemarin|semalam|tadi)\b",
    r"\b(?:sejak|dari)\s+(?:kemarin|semalam|tadi|tadi\s+(?:pagi|siang|sore|malam))\b",
    r"\b\d+\s*(?:jam|hari|minggu|bulan)\b",
    r"\bhari\s+ke\s+\d+\b",
)
INTENSITY = ("ringan", "berat", "parah", "nyeri sedang", "sakit sedang", "demam sedang", "keluhan sedang", "sangat sakit", "lebih sakit", "nyeri saat menelan", "sakit saat menelan", "kalau menelan sakit", "terasa sakit saat menelan", "nyeri menelan", "suhu", "derajat")
PROGRESSION = ("memburuk", "makin", "semakin", "bertambah", "lebih sakit", "setiap hari", "menetap", "naik turun", "ketika bangun", "bangun tidur")
DURATION_WORDS = ("hari", "jam", "minggu", "sejak", "tadi", "kemarin", "baru", "sudah", "lama")
RECOMMENDATION = ("rekomendasi", "ramuan", "herbal", "obat tradisional", "lanjut", "boleh")


@dataclass(frozen=True)
class Lexicon:
    """All lists of one language and domain. Phrases are taken as normalised: lower case, single spaces."""

    stopwords: tuple[str, ...] = STOPWORDS
    synonyms: dict[str, str] = field(default_factory=lambda: SYNONYMS)
    negations: tuple[str, ...] = NEGATIONS
    clearances: tuple[str, ...] = CLEARANCES
    red_flags: dict[str, str] = field(default_factory=lambda: RED_FLAGS)
    hints: dict[str, tuple[str, ...]] = field(default_factory=lambda: CASE_HINTS)
    symptoms: dict[str, tuple[str, ...]] = field(default_factory=lambda: SYMPTOMS)
    durations: tuple[str, ...] = DURATIONS
    intensity: tuple[str, ...] = INTENSITY
    progression: tuple[str, ...] = PROGRESSION
    duration_words: tuple[str, ...] = DURATION_WORDS
    recommendation: tuple[str, ...] = RECOMMENDATION


DEFAULT = Lexicon()
