"""Column types of the input tables, and a cast that refuses what it cannot read.

Crawls often store ids as text.  Ids are numbers here: they are ordered, ranked and joined as LONG.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCOUNTS = {
    "id": "long", "username": "string", "level": "int", "counter": "long", "statuses_count": "long",
    "recorded_friends_count": "long", "followers_count": "long", "friends_count": "long", "favourites_count": "long",
    "created_at": "timestamp", "last_message_id": "long",
}
NETWORK = {"source_id": "long", "dest_id": "long"}
MESSAGES = {
    "message_id": "long", "user_id": "long", "message": "string", "created_at": "timestamp", "retweet_count": "long",
    "favorite_count": "long", "is_rt": "boolean",
}
FEATURES = {"slice": "int", "id": "long", "group_id": "long", "feat": "string", "value": "double", "group_norm": "double"}
TRUST_SCORES = {
    "user_id": "long", "num_of_friends": "long", "wo_retweets": "double", "first_part": "double", "diff_score": "double",
}


def conform(table: DataFrame, types: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The table with its known columns cast to their types; other columns stay as they are.

    A value that is not of its type ends the query that reads it with an error naming the column.
    A missing required column is an error at once.
    """
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    present = {name: kind for name, kind in types.items() if name in table.columns}
    wrong = {field.name: field.dataType.simpleString() for field in table.schema.fields}
    casts = {}
    for name, kind in present.items():
        if wrong[name] == {"long": "bigint"}.get(kind, kind) or (kind == "timestamp" and wrong[name] == "timestamp_ntz"):
            continue
        value = F.col(name).try_cast(kind)
        message = F.concat(F.lit(f"column {name} is not a {kind}: "), F.col(name).cast("string"))
        casts[name] = F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)
    return table.withColumns(casts) if casts else table
