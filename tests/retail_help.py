"""What the tests of the retail part share. A module of its own: every folder's ``conftest`` is
imported under one name."""

SMALL = "/root/testdata/sf0.001"


def rows(frame, *order):
    """Collected rows as dicts, in the given order."""
    found = [r.asDict(recursive=True) for r in frame.collect()]
    return sorted(found, key=lambda r: tuple(str(r[c]) for c in order)) if order else found
