"""What a source of events and a data set have to offer; subclass these for other formats."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Closing(ABC):
    """Something that holds resources until it is closed."""

    @abstractmethod
    def close(self) -> None: ...

    def __enter__(self):
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class EventSource(Closing):
    """Events by place and time."""

    @property
    @abstractmethod
    def num_events(self) -> int: ...

    @abstractmethod
    def load_events(self, start: int, stop: int) -> DataFrame: ...

    @abstractmethod
    def time_to_index(self, t: int) -> int:
        """The last event strictly before t; -1 if none."""

    @abstractmethod
    def index_to_time(self, index: int) -> int: ...


class Samples(Closing):
    """Samples by number. samples has a row for each, its number in `order` dense from 0; one row at a time reaches the driver."""

    def __init__(self, samples: DataFrame, order: str = "frame_idx", on_close: Callable[[], None] = lambda: None):
        self.samples, self.order, self._on_close = samples, order, on_close

    def close(self) -> None:
        self._on_close()

    def __len__(self) -> int:
        return self.samples.count()

    def __getitem__(self, index: int) -> dict:
        at = index if index >= 0 else len(self) + index
        found = self.samples.where(self.samples[self.order] == at).first() if at >= 0 else None
        if found is None:
            raise IndexError(index)
        return found.asDict(recursive=True)

    def __iter__(self) -> SampleIterator:
        return SampleIterator(self)


class SampleIterator(Closing):
    """Samples in order; iter() starts again."""

    def __init__(self, held: Samples):
        self.held = held
        self.reset()

    def reset(self) -> None:
        self._rows: Iterator = self.held.samples.orderBy(self.held.order).toLocalIterator()

    def __iter__(self) -> SampleIterator:
        self.reset()
        return self

    def __next__(self) -> dict:
        return next(self._rows).asDict(recursive=True)

    def close(self) -> None:
        self.held.close()
