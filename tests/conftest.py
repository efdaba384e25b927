import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ring(spark):
    from veilspark.plans import fixtures as fx

    return fx.keyring(spark)


@pytest.fixture(scope="session")
def config():
    from veilspark.plans import fixtures as fx

    return fx.config()


SAMPLE = {
    "transaction_id": "TXN-20270308-000417",
    "transaction_ts": "2027-03-08T06:42:11+01:00",
    "customer_id": "CUST-AT-00451907",
    "full_name": "Mona Keller",
    "phone": "+974 5512 3456",
    "email": "mona.keller@example.org",
    "billing_address": "AT, Linz, Harbour Lane 14, Floor 2",
    "card_pan": "5555555555554444",
    "card_expiry": "04/31",
    "ip_address": "198.51.100.77",
    "device_id": "DEV-at-90be1177",
    "merchant_id": "MRC-AT-20431",
    "merchant_name": "NORTHSIDE BOOKS LINZ",
    "mcc": 5942,
    "merchant_country": "AT",
    "terminal_id": "TERM-AT-5511",
    "channel": "POS",
    "currency": "EUR",
    "amount": 310.25,
    "available_balance": 920.40,
    "credit_limit": 12000.00,
    "is_card_present": True,
}


@pytest.fixture(scope="session")
def make(spark):
    """A transactions table from changes to the sample record."""
    from veilspark.sources import schemas

    def build(*changes):
        rows = [tuple({**SAMPLE, **c}[n] for n in schemas.TRANSACTION.fieldNames()) for c in changes or ({},)]
        return spark.createDataFrame(rows, schemas.TRANSACTION)

    return build
