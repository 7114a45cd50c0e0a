"""Schemas of the files that the engine reads; none is inferred."""

MESSAGES = "tweet_id BIGINT, author_id STRING, inbound BOOLEAN, created_at STRING, text STRING, response_tweet_id STRING, in_response_to_tweet_id STRING"
TURN = "STRUCT<role: STRING, text: STRING>"
EXAMPLES = (
    "example_id STRING, conversation_id BIGINT, tweet_id BIGINT, created_at STRING, current_customer_message STRING, "
    f"conversation_context ARRAY<{TURN}>, language STRING, message_type STRING, context_dependency STRING, primary_intent STRING, "
    "secondary_intents ARRAY<STRING>, difficulty STRING, label_confidence STRING, annotation_note STRING, split STRING"
)
CASES = (
    "case_id STRING, conversation_id BIGINT, position_in_conversation INT, conv_length INT, customer_timestamp STRING, response_timestamp STRING, "
    f"language STRING, customer_message STRING, raw_customer_message STRING, conversation_context ARRAY<{TURN}>, brand_response STRING, "
    "has_usable_response BOOLEAN, template_key STRING, metadata MAP<STRING, BOOLEAN>, template_count INT, is_canned_template BOOLEAN"
)
PREDICTIONS = (
    "example_id STRING, conversation_id BIGINT, subset STRING, model STRING, input STRING, language STRING, difficulty STRING, context_dependency STRING, "
    "message_type STRING, gold_intent STRING, predicted_intent STRING, correct INT, current_message STRING, confidence DOUBLE, predicted_probability DOUBLE"
)
JUDGEMENTS = "query_id STRING, candidate_case_id STRING, level INT, note STRING"
