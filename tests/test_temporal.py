"""Temporal constructors, arithmetic, truncation and differences, folded without Spark and through a row."""

import datetime as dt

import pytest

from loomgraph.errors import GraphError
from loomgraph.functions import expressions as X
from loomgraph.functions import temporal

TEXTS = {
    "date({date: '1984-10-11', quarter: 4})": "1984-10-11", "date({year: 1984, ordinalDay: 42})": "1984-02-11", "date('198410')": "1984-10-01", "date('1984W103')": "1984-03-07", "date('1984042')": "1984-02-11", "date('1984')": "1984-01-01",
    "date({year: 1984, week: 10, dayOfWeek: 3})": "1984-03-07", "date({year: 1984, quarter: 3, dayOfQuarter: 45})": "1984-08-14", "localtime({time: '12:00:00.123456789'})": "12:00:00.123456789", "time({time: '12:00:00+01:00', timezone: '+00:00'})": "11:00:00Z",
    "time('12:00')": "12:00Z", "localdatetime('1984-10-11T12')": "1984-10-11T12:00", "datetime({datetime: '1984-10-11T12:00:00+01:00', timezone: '+00:00'})": "1984-10-11T11:00:00Z",
    "datetime({datetime: '1984-10-11T12:00:00+01:00', day: 12, timezone: '+00:00'})": "1984-10-12T11:00:00Z", "duration('P1Y2M3W4DT5H6M7.8S')": "P1Y2M25DT5H6M7.8S", "duration({})": "PT0S", "duration({months: 0.75})": "P22DT19H51M49.5S",
    "duration({days: 14, hours: 16, minutes: 12})": "P14DT16H12M", "duration('PT0.75M')": "PT45S", "duration('P2012-02-02T14:37:21.545')": "P2012Y2M2DT14H37M21.545S", "duration('-P1D')": "P-1D",
    "datetime({year: 2015, month: 7, day: 21, hour: 21, timezone: 'Europe/Stockholm'})": "2015-07-21T21:00+02:00[Europe/Stockholm]", "datetime.fromepoch(416779, 999999999)": "1970-01-05T19:46:19.999999999Z",
    "date('1984-10-11') + duration('P1M20D')": "1984-12-01", "date('2024-01-31') + duration({months: 1})": "2024-02-29", "localdatetime('2020-01-01T00:00') - duration('PT1S')": "2019-12-31T23:59:59", "time('23:00+01:00') + duration('PT2H')": "01:00+01:00",
    "duration('P1M') * 1.5": "P1M15DT5H14M33S", "duration('PT3H') / 2": "PT1H30M", "duration('P1D') + duration('PT1H') - duration('P2D')": "P-1DT1H", "duration.between(date('1984-10-11'), date('2015-06-24'))": "P30Y8M13D",
    "duration.between(localdatetime('2015-07-21T21:40:32'), date('2015-06-24'))": "P-27DT-21H-40M-32S", "duration.inMonths(date('1984-10-11'), date('2015-06-24'))": "P30Y8M", "duration.inDays(date('1984-10-11'), date('2015-06-24'))": "P11213D",
    "duration.inSeconds(time('12:00'), time('13:30:01'))": "PT1H30M1S", "date.truncate('millennium', date('2017-10-11'))": "2000-01-01", "date.truncate('weekYear', date('1984-01-01'))": "1983-01-03", "date.truncate('week', date('2017-11-11'), {dayOfWeek: 2})": "2017-11-07",
    "localdatetime.truncate('day', localdatetime('2017-11-11T12:31:14.645876'), {nanosecond: 2})": "2017-11-11T00:00:00.000000002", "time.truncate('minute', time('12:31:14.645+01:00'))": "12:31+01:00", "localtime.truncate('microsecond', localtime('12:31:14.645876123'))": "12:31:14.645876",
    "datetime.truncate('century', datetime('2017-10-11T12:00+01:00'), {day: 2})": "2000-01-02T00:00+01:00",
}
VALUES = {
    "duration('P1DT1H0.5S').nanosecondsOfSecond": 500_000_000, "duration({days: 3}).days": 3, "duration('PT90S').seconds": 90, "date('2015-07-21').weekYear": 2015, "date('2015-07-21').dayOfQuarter": 21, "localtime('12:31:14.645').millisecond": 645,
    "datetime('2015-07-21T21:40+01:00').offsetMinutes": 60, "datetime('1970-01-01T01:00+01:00').epochSeconds": 0, "time('12:00+01:00') = time('11:00Z')": True, "date('2015-01-01') < date('2014-01-01')": False, "date('2015-01-01') < time('12:00')": None, "duration('P1D') = duration('PT24H')": False,
    "date(null)": None, "date('2020-02-29') + null": None,
}


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    assert str(temporal.fold(X.parse(text))) == TEXTS[text]


@pytest.mark.parametrize("text", VALUES)
def test_values(text):
    assert temporal.fold(X.parse(text)) == VALUES[text]


@pytest.mark.parametrize("text", ["date({week: 1})", "date('2020-13-01')", "time('not')", "datetime('not')", "duration('')", "duration('P')", "duration('P1H')", "duration('PT1D')", "duration('PT')", "duration(1)", "localtime({hour: 25})", "duration({eons: 1})"])
def test_refused(text):
    with pytest.raises((GraphError, ValueError)):
        temporal.fold(X.parse(text))


def test_rows(spark):
    df = spark.sql("SELECT DATE'2024-01-31' AS d, TIMESTAMP_NTZ'2024-01-31 10:00:00' AS t")
    texts = ["d + duration('P1M1D')", "t - duration('P1MT1H')", "d >= date('2024-01-31')", "t < localdatetime('2024-02-01T00:00')", "toString(duration('P1D'))", "localdatetime('2024-01-31T10:00') = t", "datetime('2024-01-31T10:00+02:00')", "d.year"]
    got = list(df.select(*(X.column(x, X.Scope(df)).alias(f"c{i}") for i, x in enumerate(texts))).first())
    assert got == [dt.date(2024, 3, 1), dt.datetime(2023, 12, 31, 9), True, True, "P1D", True, "2024-01-31T10:00+02:00", 2024]
