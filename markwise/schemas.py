"""Schemas of the relations; nothing is ever inferred from data."""

TRAINING_CSV = "exp_num string, text string, label string"
DEFAULT_TRAINING_CSV = "exp_num string, text string, label string, exp_data string"
EXP_DATA = "question string, ideal string"

FEATURES = (
    "good array<string>, bad array<string>, "
    "archetype_good array<string>, archetype_bad array<string>, "
    "patterns_good array<string>, patterns_bad array<string>, "
    "featureLengthRatio string, featureRegexAggregateDisabled string, "
    "featureDbScanClustersArchetypeEnabled string, featureDbScanClustersPatternsEnabled string"
)
LESSON_CONFIG = (
    "question string, expectations array<struct<"
    f"expectation_id: string, expectationId: string, ideal: string, features: struct<{FEATURES}>, "
    "extras: map<string,string>>>"
)
LESSON_EXPORT = "data struct<me: struct<trainingData: struct<config: string, training: string>>>"

# Languagemodel answers; is_known arrives as a string or a boolean.
GRADER_RESPONSE = (
    "answers map<string, struct<answer_text: string, "
    "concepts: map<string, struct<is_known: string, confidence: double, justification: string>>>>"
)
