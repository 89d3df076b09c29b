"""Small inputs, and a dense restatement of the study to compare with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

USERS = "id long, is_core boolean"
NETWORK = "source_id long, dest_id long"
FEATURES = "slice int, id long, group_id long, feat string, value double, group_norm double"
SCORES = "user_id long, num_of_friends long, wo_retweets double, first_part double, diff_score double"


@dataclass
class Inputs:
    users: list  # (id, is_core)
    network: list  # (source_id, dest_id), copies allowed
    features: list  # (slice, id, group_id, feat, value, group_norm)

    def frames(self, spark):
        return (
            spark.createDataFrame(self.users, USERS),
            spark.createDataFrame(self.network, NETWORK),
            spark.createDataFrame(self.features, FEATURES),
        )


def rows_of(table: dict[int, str]) -> list:
    """'1:a=.5 1:b=.5' per slice as feature rows."""
    rows = []
    for slice_number, text in table.items():
        for item in text.split():
            user, cell = item.split(":")
            feat, value = cell.split("=")
            rows.append((slice_number, len(rows), int(user), feat, 1.0, float(value)))
    return rows


HAND = Inputs(
    users=[(user, user <= 3) for user in range(1, 7)],
    network=[(1, 4), (1, 5), (2, 5), (2, 6), (3, 4), (3, 1)],
    features=rows_of(
        {
            0: "1:a=.5 1:b=.5 1:c=.1 2:a=.2 2:b=.8 3:a=1",
            1: "1:a=.25 1:b=.75 2:a=.6 2:b=.4 2:c=.1 3:a=.5 3:b=.25 3:z=.25",
            2: "1:a=.4 1:b=.6 2:a=.4 2:b=.6 3:a=.8 3:b=.1 3:z=.1 4:a=.2 4:b=.8 5:a=.9 5:b=.1 6:a=.5 "
            + " ".join(f"{user}:c=.3" for user in range(1, 7)),
        }
    ),
)


def random_inputs(seed: int, people: int = 30, core: int = 18, topics: int = 6) -> Inputs:
    """Copies of edges and of feature rows, unknown users, absent cells, a constant and a late topic."""
    rng = np.random.default_rng(seed)
    users = [(user, user < core) for user in range(people)]
    network = [(int(rng.integers(0, people)), int(rng.integers(0, people + 8))) for _ in range(people * 9)]
    network += network[:25] + [(0, 5)] * 12
    features = []
    for slice_number in range(3):
        for user in range(people + 5):
            for topic in range(topics):
                for _ in range(int(rng.integers(0, 3))):
                    if (slice_number, topic) != (0, topics - 1):
                        features.append((slice_number, len(features), user, f"t{topic}", 1.0, float(rng.random())))
            features.append((slice_number, len(features), user, "same", 1.0, 0.25))
    order = rng.permutation(len(features))
    return Inputs(users, network, [features[i] for i in order])


class Dense:
    """slice x user x topic with zeros, built cell by cell."""

    def __init__(self, inputs: Inputs, min_degree: int, restrict: bool = True):
        everybody = [user for user, _ in inputs.users]
        self.core = [user for user, is_core in inputs.users if is_core]
        self.place = {user: i for i, user in enumerate(everybody)}
        self.friends = {user: [] for user in self.core}
        for source, dest in inputs.network:
            if source in self.friends and dest in self.place:
                self.friends[source].append(dest)
        loaded = set(self.core).union(*self.friends.values()) if restrict else set(everybody)
        self.names = sorted({row[3] for row in inputs.features})
        column = {name: i for i, name in enumerate(self.names)}
        self.values = np.zeros((3, len(everybody), len(self.names)))
        for slice_number, _, user, feat, _, score in sorted(inputs.features, key=lambda row: row[1]):
            if user in (loaded if slice_number == 2 else set(self.core)) and user in self.place:
                self.values[slice_number, self.place[user], column[feat]] = score
        self.kept = [user for user in self.core if len(self.friends[user]) >= min_degree]
        self.varying = [i for i in range(len(self.names)) if (np.ptp(self.values[:, :, i], axis=1) > 0).all()]

    def reference(self, people) -> np.ndarray:
        return self.values[2][[self.place[user] for user in people]].mean(axis=0)

    def scale(self, method):
        last = self.values[2]
        if method == "minmax":
            return np.ptp(last, axis=0)
        return last.var(axis=0) if method == "variance" else np.ones(len(self.names))

    def deltas(self, method=None, drawn=None, unaveraged=()):
        mean = self.values[2].mean(axis=0)
        tt, tf, tr = [], [], []
        for user in self.kept:
            s0, s1 = self.values[0, self.place[user]], self.values[1, self.place[user]]
            known = user not in unaveraged
            friends = self.reference(self.friends[user]) if known else mean
            base = mean if drawn is None or not known else self.reference(drawn[user])
            tt.append(s1 - s0), tf.append(friends - s0), tr.append(base - s0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.array(part) / self.scale(method) for part in (tt, tf, tr)]

    def cosines(self, **options) -> dict:
        tt, tf, tr = self.deltas(**options)

        def cosine(a, b):
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            return a @ b / norm if norm else 0.0

        return {self.names[i]: (cosine(tt[:, i], tf[:, i]), cosine(tt[:, i], tr[:, i])) for i in self.varying}

    def fits(self, **options) -> dict:
        tt, tf, tr = self.deltas(**options)
        result = {}
        for i in self.varying:
            x, y = np.column_stack([tf[:, i], tr[:, i]]), tt[:, i]
            slopes = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-8)[0]
            intercept = y.mean() - x.mean(axis=0) @ slopes
            result[self.names[i]] = (*slopes, intercept, np.abs(y - x @ slopes - intercept).mean())
        return result


def by_topic(frame, *names) -> dict:
    return {row["feat"]: tuple(row[name] for name in names) for row in frame.collect()}


def assert_close(actual: dict, expected: dict, tolerance: float = 1e-9) -> None:
    assert actual.keys() == expected.keys()
    for key, values in expected.items():
        np.testing.assert_allclose(actual[key], values, rtol=0, atol=tolerance, err_msg=str(key))
