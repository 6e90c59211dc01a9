"""What goes to the tasks with a function is the function."""

from __future__ import annotations

from pyspark import cloudpickle

from pairloom.llm import decontamination, scan, segmentation


def test_tables_of_the_driver_stay_there():
    windows = decontamination.Windows([(1, "a few words of a benchmark item")], 13)  # made by the driver
    assert windows.items and scan._powers
    for travels in (scan.Sums, segmentation.Block, decontamination.find):
        assert len(cloudpickle.dumps(travels)) < 100_000
    again = cloudpickle.loads(cloudpickle.dumps(scan._power))
    assert again(3, 4).tolist() == [1, 3, 9, 27, 81]
