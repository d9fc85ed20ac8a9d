"""Results match only when these equal the published ones."""

# Colour words that are kept, and the ratings' range.
BASE_COLORS = [
    "red", "blue", "green", "black", "white", "grey", "gray", "brown",
    "yellow", "pink", "purple", "orange", "silver", "gold", "beige",
    "navy", "teal", "ivory", "cream", "tan", "maroon", "coral", "cyan",
    "magenta", "turquoise", "charcoal", "multicolor", "multi",
]
COLOR_SEPARATORS = r"[/,|&\-\s]+"
RATING_RANGE = (0.0, 5.0)

# Label to gain, id prefix and source name of the two datasets.
ESCI_GAINS = {
    "EXACT": 3.0, "E": 3.0,
    "SUBSTITUTE": 2.0, "S": 2.0,
    "COMPLEMENT": 1.0, "C": 1.0,
    "IRRELEVANT": 0.0, "I": 0.0,
}
WANDS_GAINS = {"EXACT": 2.0, "PARTIAL": 1.0, "IRRELEVANT": 0.0}
ESCI_PREFIX = "amz_"
WANDS_PREFIX = "wands_"
JUDGED_PER_QUERY = 40

# Raw columns of the two datasets that go to a product's metadata.
ESCI_METADATA = ["product_title", "product_description", "product_bullet_point", "product_brand", "product_color"]
WANDS_METADATA = [
    "product_name", "product_class", "category hierarchy", "product_description",
    "product_features", "rating_count", "average_rating", "review_count",
]

# Phrases that open a conversational query, in matching order, and
# filler words dropped anywhere.  The second list also takes an article that is
# only the start of the next word.
LEAD_INS = [
    r"i(?:'d|'m)?\s+(?:would\s+)?love\s+to\s+(?:find|buy|get|check\s+out|look\s+at|see)",
    r"i(?:'d|'m)?\s+(?:would\s+)?love\s+(?:to\s+)?(?:(?:find|buy|get|some|a|an)\b)?",
    r"i(?:'m)?\s+(?:am\s+)?looking\s+for\s+(?:(?:a|an|some)\b)?",
    r"i\s+(?:want|need|would\s+like)\s+(?:to\s+(?:find|buy|get)\s+)?(?:(?:a|an|some)\b)?",
    r"(?:can\s+you\s+)?(?:show|find|get|give|help\s+me\s+find)\s+me\s+(?:(?:a|an|some)\b)?",
    r"(?:looking|searching|hunting|shopping)\s+for\s+(?:(?:a|an|some)\b)?",
    r"(?:please|hey|hi|hello)\s+",
]
LEAD_INS_LEGACY = [
    r"i(?:'d|'m)?\s+(?:would\s+)?love\s+to\s+(?:find|buy|get|check\s+out|look\s+at|see)",
    r"i(?:'d|'m)?\s+(?:would\s+)?love\s+(?:to\s+)?(?:find|buy|get|some|a|an)?",
    r"i(?:'m)?\s+(?:am\s+)?looking\s+for\s+(?:a|an|some)?",
    r"i\s+(?:want|need|would\s+like)\s+(?:to\s+(?:find|buy|get)\s+)?(?:a|an|some)?",
    r"(?:can\s+you\s+)?(?:show|find|get|give|help\s+me\s+find)\s+me\s+(?:a|an|some)?",
    r"(?:looking|searching|hunting|shopping)\s+for\s+(?:a|an|some)?",
    r"(?:please|hey|hi|hello)\s+",
]
FILLERS = r"\b(?:some|cool|nice|good|great|awesome|amazing)\b\s*"

# Queries that get no generated product title.
NO_TITLE_FOR = r"\d{2,}|\b(?:amazon|book|film|movie|song|album)\b"

# Searched fields with their boosts, and the BM25 constants.
FIELD_BOOSTS = {"title": 5.0, "brand_text": 4.0, "bullets": 2.0, "description": 0.3}
BM25_K1 = 1.2
BM25_B = 0.75

# Fusion constant, pool sizes, cutoffs.
RRF_K = 60
POOL_FUSION = 50
POOL_RERANK = 25
CUTOFFS = [5, 10, 20]
MAX_ROUNDS = 2

# Text limits and formats shown to a model.
PASSAGE_CHARS = 300
SUMMARY_HITS = 5
SUMMARY_CHARS = 200
NO_HITS = "No results returned by retrieval."

# Quality labels and actions of the result check.
QUALITIES = ["good", "low_coverage", "wrong_category", "semantic_drift", "multi_constraint_miss"]
ACTIONS = ["return", "widen", "decompose"]
WEAK_SCORE = 0.1
GOOD_SCORE = 0.5
GOOD_HITS = 3
