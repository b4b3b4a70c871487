import zipfile
from types import SimpleNamespace

from oscilla import session


def test_package_is_sent_once_where_it_is_missing(monkeypatch, tmp_path):
    sent = []
    fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app-1", addPyFile=sent.append))
    session.ship(fake)
    assert not sent  # this folder is on the path of local workers
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    session.ship(fake)
    session.ship(fake)
    assert len(sent) == 1 and "oscilla/plans/signals.py" in zipfile.ZipFile(sent[0]).namelist()
