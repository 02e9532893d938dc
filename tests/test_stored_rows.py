"""Joined rows that several jobs read are stored once."""

from tabkit.plans.catalogue import fits


def test_near_reconstruction_reads_stored_rows(spark, sf, monkeypatch):
    seen, real = [], fits.R.near_reconstruction

    def watched(train, test, columns, label):
        seen.extend(rows._jdf.queryExecution().optimizedPlan().toString() for rows in (train, test))
        return real(train, test, columns, label)

    monkeypatch.setattr(fits.R, "near_reconstruction", watched)
    assert fits.near_reconstruction(spark, sf).count() == 3
    assert len(seen) == 2 and not any("Join" in plan for plan in seen)
