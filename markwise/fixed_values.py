"""Values that have to equal the grading service's for results to agree."""

# --- fixed values: labels, evaluations, feature keys -----------------------
GOOD = "good"
BAD = "bad"
NEUTRAL = "neutral"
EVALUATION_GOOD = "Good"
EVALUATION_BAD = "Bad"

FEATURE_LENGTH_RATIO = "featureLengthRatio"
FEATURE_REGEX_AGGREGATE_DISABLED = "featureRegexAggregateDisabled"
FEATURE_ARCHETYPE_ENABLED = "featureDbScanClustersArchetypeEnabled"
FEATURE_PATTERNS_ENABLED = "featureDbScanClustersPatternsEnabled"

ARCH_REGRESSION = "lr2"
ARCH_LANGUAGE_MODEL = "openai"
ARCH_COMPOSITE = "composite"
DEFAULT_LESSON = "default"

# --- fixed values: thresholds ----------------------------------------------
MIN_GRADED_ROWS = 10
CONFIDENCE_THRESHOLD = 0.6
TRAIN_QUALITY = 2
CLUSTER_RADIUS = 0.30
CLUSTER_MIN_SAMPLES = 5
REPRESENTATIVE_MAX_TOKENS = 20
REPRESENTATIVE_MIN_SENTENCES = 5
TOURNAMENT_BATCH = 10
PATTERN_CUTOFF = 0.80
PATTERN_TOP_N = 20
PATTERN_SELECT_N = 10
GROUND_TRUTH_LIMIT = 100
PROMPT_TOKEN_LIMIT = 4000
JOB_TTL_DAYS = 20
# how long an answer waits for the language-model grader
GRADER_LIMIT = "10 seconds"
EMBEDDING_DECIMALS = 9

# --- fixed values: words that are written with a leading bar in YAML -------
ESCAPE = "|"
ESCAPED_WORDS = ["true", "false", "on", "off", "yes", "no", "|"]

# --- fixed values: negation words ------------------------------------------
NEGATION_WORDS = [
    "no", "never", "nothing", "nowhere", "none", "not", "havent", "hasnt",
    "hadnt", "cant", "couldnt", "shouldnt", "wont", "wouldnt", "dont",
    "doesnt", "didnt", "isnt", "arent", "aint",
]
NEGATION_MARK = "[NEG]"

# --- fixed values: stop words ----------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "did", "doing",
    "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "each", "few", "more", "most", "other",
    "some", "such", "only", "own", "so", "than", "too", "very", "can",
    "will", "just", "should", "should've", "now", "ll", "re", "ve", "'s",
    " ",
]

# --- fixed values: word map applied after stop-word removal ----------------
WORD_MAP = {"n't": "not"}

# --- fixed values: speech-act patterns -------------------------------------
METACOGNITIVE = (
    r"\b(idk|belie\w*|don\w*|comprehend\w*|confuse\w*|guess\w*"
    r"|(?<=n[o']t)\s?\b(know\w*|underst\w*|follow\w*|recogniz\w*|sure\w*|get)\b"
    r"|messed|no\s?(idea|clue)|lost|forg[eo]t|need\s?help|imagined?"
    r"|interpret(ed)?|(seen?|saw)|suppos(ed)?)\b"
)
PROFANITY = (
    r"\b(\w*fuck\w*|ass|ass(hole|wipe|wad|kisser)|hell|shit|piss\w*|cock"
    r"|cock(sucker|head|eater)|douche\w*|bitch\w*|retard[ed]|midget\w*|dyke"
    r"|fag|faggot|cunt\w*|\w*nigg\w*|tranny|slut\w*|cum[bucket]|dick\w*"
    r"|pussy\w*|dildo\w*|idiot\w*|(hate you)|stupid\w*)\b"
)

# --- fixed values: texts of the grader prompt ------------------------------
PROMPT_SYSTEM = 'The user provided a list of one or more "answers" to a tutoring question. The answers are provided in JSON format. You are a tutor who is evaluating if the answer is sufficient to show that the user knows a one or more "concepts" which will be labeled "concept_1" to "concept_N". For each answer you evaluate, you must also express how confident you are in your evaluation of how well the answer shows knowledge of each concept. You will also provide a brief justification.'
PROMPT_TEMPLATE = {
    "Please respond in the following format": {
        "answers": {
            "answer_N": {
                "answer_text": "string // State the text of the particular answer being classified.",
                "concepts": {
                    "concept_N": {
                        "is_known": "string // true or false. If the input answer implies that the concept is known, the classification should be true. Otherwise it should be false.",
                        "confidence": "float // A 0 to 1 score indicating certainty that a classification is correct. Confidence scores closer to 1 represent higher certainty, and confidence scores closer to 0 represent lower certainty.",
                        "justification": "string // Why you believe the user answer is or is not sufficient to determine if they know the concepts.",
                    }
                },
            }
        }
    }
}
PROMPT_GUARDRAILS = "Only respond with the JSON output in the exact format of the template and no other words or symbols. The output must be valid JSON. Check that the output is valid JSON. \n\n"
PROMPT_GROUND_TRUTH = "Here are some examples that have already been labeled. They are presented in JSON format, where the answer is given, followed by each concept and a true or false label. Consider these to be ground truth examples.\n"
PROMPT_MODEL_LARGE = "gpt-4.1-mini"
PROMPT_MODEL_SMALL = "gpt-4o-mini"
