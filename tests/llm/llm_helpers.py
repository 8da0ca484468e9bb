"""What several tests share."""


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def texts_of(frame):
    return {r.doc_id: r.text or "" for r in frame.collect()}
