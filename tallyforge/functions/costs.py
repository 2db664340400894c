"""What requests cost, as columns. ``Price``: a struct of input, output and cached_input (null: a tenth of input)
dollars for a million tokens; a null price costs nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices of cache writes and reads in terms of input, of batches, of a search, and what a search adds.
WRITE, WRITE_HOUR, READ, BATCHED, SEARCH = 1.25, 2.0, 0.10, 0.5, 0.01
SEARCH_TOKENS = 10_000


def cost(price: Column, tokens: Column, output: Column, *, written: Column | None = None, written_hour: Column | None = None, read: Column | None = None, searches: Column | None = None, batched: Column | None = None) -> Column:
    """Dollars of one request: five kinds of tokens, half of it in a batch, and its searches. ``written_hour``: how many of
    the ``written`` tokens are written for an hour."""
    none = F.lit(0)
    written, written_hour, read, searches = (x if x is not None else none for x in (written, written_hour, read, searches))
    share = F.lit(1e-6) if batched is None else F.when(batched, 1e-6 * BATCHED).otherwise(1e-6)
    cached = F.coalesce(price["cached_input"], price["input"] * READ)
    each = tokens * price["input"] + output * price["output"] + (written - written_hour) * price["input"] * WRITE + written_hour * price["input"] * WRITE_HOUR + read * cached
    return F.when(price.isNull(), 0.0).otherwise(searches * SEARCH + share * each)


def worst_case(price: Column, tokens: Column, most: Column, *, cached: bool = False, hour: bool = False, searches: Column | None = None, batched: Column | None = None) -> Column:
    """The most that a request can cost: all of its output, and all of its input at the price of writing it if cached."""
    tokens = tokens if searches is None else tokens + searches * SEARCH_TOKENS
    if not cached:
        return cost(price, tokens, most, searches=searches, batched=batched)
    return cost(price, F.lit(0), most, written=tokens, written_hour=tokens if hour else None, searches=searches, batched=batched)


def affordable_output(price: Column, tokens: Column, limit: Column, *, cached: bool = False, hour: bool = False, searches: Column | None = None, batched: Column | None = None) -> Column:
    """The most output tokens whose worst case stays within a limit, less one for rounding. Tokens are brought to millions
    before they meet the price, as the order of the factors decides the last bits and so whole tokens."""
    share = F.lit(1e-6) if batched is None else F.when(batched, 1e-6 * BATCHED).otherwise(1e-6)
    tokens = tokens if searches is None else tokens + searches * SEARCH_TOKENS
    spent = share * tokens * price["input"]
    if cached:
        spent = spent * (WRITE_HOUR if hour else WRITE)
    spare = limit - (spent if searches is None else searches * SEARCH + spent)
    return F.when(price.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(spare / (price["output"] * 1e-6)) - 1)).cast("long")


def run_estimate(price: Column, cases: Column, calls: Column, tokens: Column, most: Column, cached: Column, *, hour: bool = False, batched: Column | None = None) -> Column:
    """The most that a run can cost: one request writes the cached beginning, all others read it."""
    n, fresh = cases * calls, F.greatest(tokens - cached, F.lit(0))
    first = cost(price, fresh, most, written=cached, written_hour=cached if hour else None, batched=batched)
    return F.when(n == 0, 0.0).otherwise(first + (n - 1) * cost(price, fresh, most, read=cached, batched=batched))


def refusal(price: Column, worst: Column, limit: Column) -> Column:
    """Why a request isn't sent; null if it is. Without a price no limit can hold it."""
    return F.when(price.isNull(), "no price").when(worst > limit, "above the limit")


def back_off(attempt: Column, base: float, most: float, seed: Column) -> Column:
    """Seconds before a retry: a share, drawn by a hash of the seed, of the doubled and capped wait."""
    drawn = F.shiftrightunsigned(F.xxhash64(seed, attempt), 11) / F.lit(float(1 << 53))
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt)) * drawn
