"""Venues and asset classes of known tickers and names."""

from pyspark.sql import functions as F

from tidemark.functions import names


def test_venues(spark):
    known = {
        "EURUSD=X": "FX", "GC=F": "CMES", "BTC-USD": "CRYPTO", "eth-btc": "CRYPTO", "BRK-B": "XNYS", "GOLD.SHEET": "XBOM", "JEERA.NCDEX": "XBOM", "INFY.NS": "XBOM", "SHEL.L": "XLON", "7203.T": "XTKS", "VOW.DE": "XETR",
        "^GSPC": "XNYS", "^N225": "XTKS", "^NSEBANK": "XBOM", "^CNXIT": "XBOM", "^UNKNOWN": "", "IBM": "XNYS", "BF.B": "XNYS", " ibm ": "XNYS", "": "", "A/B": "", "--": "",
    }
    rows = spark.createDataFrame([(t,) for t in known], "t string").select("t", names.venue(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == known


def test_asset_blocks(spark):
    known = {
        ("Equity Volatility (VIX)", None): "Volatility", ("US 10Y Treasury", None): "Rates", ("Gold", None): "Metals", ("US Energy Sector", None): "Equity", ("Crude Oil", None): "Energy", ("USD/INR", None): "Currency", ("eur/usd", None): "Currency",
        ("Investment grade corporate", "LQD"): "Credit", ("TLT", None): "Rates", ("Something", "XLE"): "Energy", ("Nothing known", "ZZZ=F"): "Commodity Broad", ("Nothing known", "ABC=X"): "Currency", ("^XYZ", None): "Equity", ("plain", None): "Other",
        ("Cotton", None): "Agriculture", ("Commodity Index", None): "Commodity Broad", ("US TIPS", None): "Inflation", ("Global REIT", None): "Real Assets", (None, None): "Other",
    }
    rows = spark.createDataFrame([*known], "name string, ticker string").select("name", "ticker", names.asset_block(F.col("name"), F.col("ticker")).alias("b")).collect()
    assert {(r.name, r.ticker): r.b for r in rows} == known
