"""From quiz answers and logs to ranked shops with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyshelf.operators import preference, profile


def rank_shops(answers: DataFrame, past: DataFrame, log_vectors: DataFrame, items: DataFrame, shops: DataFrame, *,
               affinity: DataFrame | None = None, country: str | None = None, n: int = 5) -> DataFrame:
    """Best shops per user with the reasons: (user, place, shop, score, reason).

    ``answers`` has user, question, option; ``past`` and ``log_vectors`` have user, feature, weight.
    """
    profiles, tally = profile.shop_profiles(items, shops)
    weights = preference.blend(preference.answer_weights(answers), past, log_vectors)
    ranked = preference.score_shops(
        weights, profiles, affinity, n=n, shops=shops, country=country
    )
    why = profile.reasons(ranked, weights, profiles, tally)
    return ranked.join(why, ["user", "shop"], "left").na.fill("", ["reason"])
