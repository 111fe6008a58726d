"""Labels from long class lists: thousands of names, one pass over each text.

The same rule as ``functions.labels`` (longest name first, given order on ties, whole words
only, the first class where none is found), which tries a pattern for each name and so suits
short lists. Here the names form one automaton, made on the driver and broadcast; its size is
checked. Texts are upper-cased by Spark and read in Arrow batches; nothing is shuffled.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import Automaton
from ..functions.labels import clean_classes, search_order

#: Bytes of automaton that may be broadcast: about two million bytes of names of one alphabet.
MOST_BYTES = 512 << 20
#: Bytes of text that take their steps together.
STEP_BYTES = 4 << 20


def automaton(classes, most_bytes=MOST_BYTES):
    """(automaton, names in search order) of a class list."""
    order = search_order(classes)
    made = Automaton([name.encode() for name in order])
    if made.nbytes > most_bytes:
        raise ValueError(f"the automaton of these classes takes {made.nbytes} bytes, more than {most_bytes}")
    return made, order


def _runs(texts: pa.Array):
    """(bytes, offsets) of runs of texts of about STEP_BYTES."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, spans, data = texts.buffers()
    offsets = np.frombuffer(spans, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + STEP_BYTES, "right")) - 1)
        yield data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def with_label(df: DataFrame, text: str, classes, name="label", most_bytes=MOST_BYTES) -> DataFrame:
    """Add the label of a text column; null for null."""
    first = clean_classes(classes)[0]
    made, order = automaton(classes, most_bytes)
    shared = df.sparkSession.sparkContext.broadcast((made, pa.array([*order, first])))

    @F.arrow_udf("string")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, names = shared.value
        for texts in batches:
            # -1, where no name was found, is the first class
            found = [machine.first_words(data, offsets) for data, offsets in _runs(texts)]
            number = np.concatenate([*found, np.zeros(0, np.int64)])
            number[number < 0] = len(names) - 1
            yield names.take(pa.array(number, mask=texts.is_null().to_numpy(zero_copy_only=False)))

    return df.withColumn(name, label(F.upper(text)))
