"""What is sent to a second-stage verifier, as columns; the pictures themselves come as JPEG bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the question put to the verifier.
PROMPT = "Does this image show: {query}? Answer with a single word: yes or no."


def payload_size(width: Column, height: Column, longest: int = 768) -> Column:
    """Size of the picture that is sent: longest side at most ``longest``, never enlarged: ``w, h``."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("w"), F.floor(height * scale).cast("int").alias("h"))


def question(query: Column, prompt: str = PROMPT) -> Column:
    """The prompt with the query in its place."""
    before, _, after = prompt.partition("{query}")
    return F.concat(F.lit(before), query, F.lit(after))


def chat_request(jpeg: Column, query: Column, model: str, *, prompt: str = PROMPT, most_tokens: int = 3, alternatives: int = 5) -> Column:
    """The JSON body of a chat completion that shows a picture and asks about it, with the first tokens' probabilities."""
    picture = F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(jpeg), r"\s", ""))  # Spark may break the lines
    shown = F.struct(F.lit("image_url").alias("type"), F.struct(picture.alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"))
    asked = F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), question(query, prompt).alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(shown, asked).alias("content"))
    settings = F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.lit(most_tokens).alias("max_tokens"), F.lit(True).alias("logprobs"), F.lit(alternatives).alias("top_logprobs")
    return F.to_json(F.struct(*settings, F.array(message).alias("messages")))
