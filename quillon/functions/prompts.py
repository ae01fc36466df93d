"""Messages to a model, and the JSON schemas of its replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of aspects (fixed values): what an item is, what it has or does, what it is for.
ASPECT_KINDS = ("ontological", "functional", "teleological")
VERDICTS = ("positive", "negative", "inconclusive")

TAG = "List what this review says of the place as tags: lower-case words joined by hyphens, the sentiment, a quote from the review as evidence, and your confidence from 0 to 1. Reply in JSON."
INFO = "Say which kind of aspect this is (ontological, functional or teleological), and give three to six other words in lower case that reviews may use for it. Reply in JSON."
JUDGE = {
    "ontological": "Does the review show that the place is, or is not, of this kind?",
    "functional": "Does the review show that the place has or does this, well or badly?",
    "teleological": "Does the review show that the place suits, or does not suit, this purpose?",
}
JUDGE_REPLY = " Answer positive, negative or inconclusive, with your confidence from 0 to 1 and a reason of a sentence or two. Reply in JSON."
SCORE = "Rate from 0 to 1 how well the review supports the aspect; explain it in short and quote the review as evidence. Reply in JSON."
DECOMPOSE = "Take this request apart into the aspects that a place must satisfy, each in a few words. Reply in JSON."
KEYWORD = "Name the one thing that this sentence praises or blames, in at most three words. Reply with these words only."
#: Worked examples: what is said, and the reply to it.
TAG_SHOTS = (
    (
        "The soup came cold twice, yet our waiter was kind and the garden is lovely on a summer evening.",
        '{"tags":[{"name":"food-temperature","sentiment":"negative","evidence":"The soup came cold twice","confidence":0.9},{"name":"staff","sentiment":"positive","evidence":"our waiter was kind","confidence":0.85},{"name":"garden","sentiment":"positive","evidence":"the garden is lovely","confidence":0.9}]}',
    ),
    (
        "A proper village bakery, though hardly a spot to sit and read.",
        '{"tags":[{"name":"bakery","sentiment":"positive","evidence":"A proper village bakery","confidence":0.9},{"name":"reading","sentiment":"negative","evidence":"hardly a spot to sit and read","confidence":0.8}]}',
    ),
    ("We went there on Tuesday.", '{"tags":[]}'),
)
DECOMPOSE_SHOTS = (
    ("Somewhere cheap for noodles near the station where I can work for an hour or two", '{"aspects":["cheap","noodles","near the station","good for working"]}'),
    ("A bar with live jazz and no entrance fee", '{"aspects":["bar","live jazz","no entrance fee"]}'),
)
REQUEST = "Write a request, as a person looking for a place would, that asks for all of these aspects and says how much each matters. Reply with the request only."

#: JSON schemas of replies by prompt; keys in alphabetical order, as they are written.
SCHEMAS = {
    "aspects": '{"name":"aspects","schema":{"additionalProperties":false,"properties":{"aspects":{"items":{"type":"string"},"type":"array"}},"required":["aspects"],"type":"object"}}',
    "info": '{"name":"aspect_info","schema":{"additionalProperties":false,"properties":{"aspect_type":{"enum":["ontological","functional","teleological"],"type":"string"},"starter_keywords":{"items":{"type":"string"},"maxItems":6,"minItems":3,"type":"array"}},"required":["aspect_type","starter_keywords"],"type":"object"}}',
    "score": '{"name":"score","schema":{"additionalProperties":false,"properties":{"evidence":{"maxLength":200,"type":"string"},"explanation":{"maxLength":300,"type":"string"},"score":{"maximum":1,"minimum":0,"type":"number"}},"required":["score","explanation","evidence"],"type":"object"}}',
    "tags": '{"name":"tags","schema":{"additionalProperties":false,"properties":{"tags":{"items":{"additionalProperties":false,"properties":{"confidence":{"maximum":1,"minimum":0,"type":"number"},"evidence":{"type":"string"},"name":{"maxLength":64,"type":"string"},"sentiment":{"enum":["positive","negative"],"type":"string"}},"required":["name","sentiment","evidence","confidence"],"type":"object"},"type":"array"}},"required":["tags"],"type":"object"}}',
}


def _turns(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content")) for role, text in turns])


def chat(system: Column | str, *user: Column, shots: tuple[tuple[str, str], ...] = ()) -> Column:
    """A system message, worked examples (what is said and the reply) and user messages as one list; null texts are empty."""
    first = F.lit(system) if isinstance(system, str) else system
    shown = [turn for said, reply in shots for turn in (("user", F.lit(said)), ("assistant", F.lit(reply)))]
    return _turns(("system", first), *shown, *(("user", u) for u in user))


def plain_messages(text: Column) -> Column:
    """A text as a list of one user message; null is empty."""
    return _turns(("user", text))


def _said_of(aspect: Column, query: Column, text: Column) -> Column:
    """The review first, then what is asked of it; null parts are empty."""
    parts = [F.concat(F.lit(name), F.coalesce(part, F.lit(""))) for name, part in (("Review of the place:\n", text), ("What to look for: ", aspect), ("Because of the request: ", query))]
    return F.concat_ws("\n\n", *parts)


def tag_messages(text: Column) -> Column:
    return chat(TAG, text, shots=TAG_SHOTS)


def info_messages(aspect: Column, query: Column) -> Column:
    """The request stands in a turn of its own, as it only helps to read the aspect."""
    return chat(INFO, F.concat(F.lit("Somebody asked: "), F.coalesce(query, F.lit(""))), F.concat(F.lit("Of this, tell me about: "), F.coalesce(aspect, F.lit(""))))


def judge_messages(aspect: Column, kind: Column, query: Column, text: Column) -> Column:
    """The question depends on the kind of aspect; an unknown kind is asked as a functional one."""
    ask = F.coalesce(*[F.when(kind == k, F.lit(JUDGE[k])) for k in ASPECT_KINDS], F.lit(JUDGE["functional"]))
    return chat(F.concat(ask, F.lit(JUDGE_REPLY)), _said_of(aspect, query, text))


def score_messages(aspect: Column, query: Column, text: Column) -> Column:
    return chat(SCORE, _said_of(aspect, query, text))


def decompose_messages(request: Column) -> Column:
    return chat(DECOMPOSE, request, shots=DECOMPOSE_SHOTS)


def keyword_messages(segment: Column) -> Column:
    return chat(KEYWORD, segment)


def request_messages(aspects: Column) -> Column:
    """``aspects``: an array of structs with keyword, importance and performance."""
    lines = F.transform(aspects, lambda a: F.concat(F.lit("- "), a["keyword"], F.lit(" (importance "), a["importance"], F.lit(", performance "), a["performance"], F.lit(")")))
    return chat(REQUEST, F.array_join(lines, "\n"))
