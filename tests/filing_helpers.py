"""What several test modules share; a name of its own, since each folder has a ``conftest``."""

SF = "/root/testdata/sf0.001"


def dicts(df):
    return [r.asDict() for r in df.collect()]
