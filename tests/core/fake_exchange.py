"""A client whose candles lie on a grid, for tests."""

from tidemark.sources.exchange import NetworkError

T0 = 1_600_000_000_000 // 60_000 * 60_000
MINUTE = 60_000


class Grid:
    def __init__(self, start=T0, stop=T0 + 250 * MINUTE, fail=0, step=MINUTE):
        self.start, self.stop, self.fail, self.step, self.calls = start, stop, fail, step, 0

    def fetch(self, symbol, timeframe, since_ms, limit):
        self.calls += 1
        if self.fail:
            self.fail -= 1
            raise NetworkError("again")
        first = -(-max(self.start, since_ms) // self.step) * self.step
        return [[t, 1.0, 2.0, 0.5, 1.5, 10.0] for t in range(first, self.stop, self.step)][:limit]


def grid():
    return Grid()


class Logged(Grid):
    """Notes each call in a file, as every task has a client of its own."""

    def __init__(self, path):
        super().__init__(start=0, stop=T0 + 10**9, step=900_000)
        self.path = path

    def fetch(self, *args):
        with open(self.path, "a") as f:
            f.write("x")
        return super().fetch(*args)
