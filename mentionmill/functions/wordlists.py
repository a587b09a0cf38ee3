"""Fixed values of the sentiment rules: constants and German word lists."""

# How much a degree adverb, capitals and a negation change a valence.
BOOST = 0.293
CAPS = 0.733
NEGATION = -0.74

# Weight of a degree adverb one, two and three words before the valence word.
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)

# Emphasis per exclamation mark (four count at most), per question mark (two or three), and beyond.
EXCLAMATION = 0.292
QUESTION = 0.18
MANY_QUESTIONS = 0.96

# Normalisation constant of the compound score.
ALPHA = 15

# Punctuation that is stripped from one end of a word.
PUNCTUATION = [
    ".", "!", "?", ",", ";", ":", "-", "'", '"',
    "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?",
]

NEGATIONS = [
    "nicht", "nie", "never", "niemals", "keine", "nope", "nichts", "weder", "nix", "nirgendwo",
    "uhuh", "uh-uh", "ohne", "selten", "kaum", "seltentst", "rar", "trotz", "trotzdem", "obwohl",
]

INTENSIFIERS = [
    "absolut", "total", "unbedingt", "erstaunlich", "enorm", "komplett", "restlos", "gänzlich",
    "völlig", "beträchtlich", "erheblich", "deutlich", "ausgesprochen", "eindeutig", "zutiefst",
    "verdammt", "überaus", "besonders", "außerordentlich", "außergewöhnlich", "ungemein", "äußerst",
    "extrem", "sagenhaft", "verfickt", "sehr", "massiv", "mega", "höchst", "immens", "so",
    "wesentlich", "über",
]

DAMPENERS = [
    "fast", "nahezu", "beinahe", "beinah", "kaum", "geradeso", "irgendwie", "ziemlich", "quasi",
    "geringfügig", "unwesentlich", "marginal", "zeitweise", "gelegentlich", "mitunter", "halbwegs",
    "teils", "tweilweise", "etwas", "bisschen", "einigermaßen", "derlei", "gewissermaßen",
]

# Phrases whose valence replaces that of the word inside.
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "kiss of death": -1.5}
