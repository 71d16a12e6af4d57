"""Default phrase lists: a few examples of our own for each rule, in alphabetical order. They show what a rule looks for; a user's own
tables replace them (see phrase_table)."""

from __future__ import annotations

from pyspark.sql import DataFrame

PHRASES: dict[str, tuple[str, ...]] = {
    "r-001": ("bespoke", "delve", "holistic", "paradigm", "robust", "synergy", "tapestry", "transformative"),
    "r-002": ("acts as", "comprises", "constitutes", "serves as"),
    "r-003": ("as a matter of fact", "due to the fact that", "for all intents and purposes", "it is worth noting"),
    "r-004": ("as a language model", "feel free to ask", "happy to help", "hope this helps"),
    "r-005": ("dreamlike", "lavish", "one-of-a-kind", "opulent", "postcard-perfect", "sun-drenched"),
    "r-006": ("beacon", "gateway", "lifeblood", "testament", "treasure trove"),
    "r-008": ("as of my last update", "i have no access to", "my training data"),
    "r-031": ("game changer", "milestone", "pivotal moment", "watershed"),
    "r-032": ("analysts agree", "commentators say", "experts say", "research suggests"),
    "r-033": ("despite these challenges", "hurdles remain", "not without its problems"),
    "r-035": ("and this is just the start", "better days lie ahead", "onwards and upwards", "the sky is the limit"),
    "r-038": ("a matter of perspective", "on the one hand", "there is no right answer"),
}
OPENERS: dict[str, tuple[str, ...]] = {
    "r-007": ("besides", "hence", "moreover", "similarly", "thus"),
    "r-024": ("all in all", "in closing", "in conclusion", "to wrap up"),
    "r-027": ("first things first", "here's what", "in this article", "let me walk you through"),
}
HEDGES = ("apparently", "conceivably", "might", "perhaps", "presumably", "probably", "roughly", "somewhat")
OPINIONS = ("i guess", "i reckon", "i suppose", "i think", "if you ask me", "to my mind")
PARTICIPLES = ("confirming", "hinting", "proving", "revealing", "showing", "suggesting", "turning")
IRREGULAR = ("born", "brought", "caught", "chosen", "driven", "eaten", "felt", "grown", "lost", "sold", "told", "worn")
RANGE_STARTS = ("[0-9]", "april", "dawn", "dusk", "head to", "noon", "page", "sunday", "tuesday")
NOT_ADVERBS = ("burly", "butterfly", "doily", "dragonfly", "family", "gully", "homily", "jelly", "panoply", "reply", "surly", "tally", "wily")
VOICE = ("i", "me", "mine", "my", "myself", "our", "ours", "ourselves", "us", "we")


MOST_PHRASES = 100_000


def phrase_table(df: DataFrame) -> dict[str, tuple[str, ...]]:
    """Phrase lists from a table (rule string, phrase string); ValueError beyond MOST_PHRASES, since they become patterns in the plan."""
    out: dict[str, list[str]] = {}
    rows = df.select("rule", "phrase").orderBy("rule", "phrase").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    for r in rows:
        out.setdefault(r["rule"], []).append(r["phrase"])
    return {k: tuple(v) for k, v in out.items()}
