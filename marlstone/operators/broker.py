"""A paper broker: orders from weights, and their fills with fees, taxes and a limit of cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOT = 100
FILLS = "struct<seq:bigint,ticker:string,status:string,quantity:bigint,price:double,commission:double,tax:double,cash:double,held:bigint,avg_cost:double>"
HELD = "map<string,struct<q:bigint,c:double>>"


def orders_from_weights(targets: DataFrame, positions: DataFrame, prices: DataFrame, cash: float, lot: int = LOT) -> DataFrame:
    """(ticker, side, quantity, price): whole lots from what is held to the target weights (ticker, weight).

    The capital is the cash and all that is held at its price. A negative weight sells what is held; tickers without a
    price of over zero are left out, and so are those whose holding fits.
    """
    held = positions.select("ticker", F.col("quantity").cast("long").alias("held"))
    px = prices.select("ticker", "price")
    worth = held.join(px, "ticker").agg((F.lit(cash) + F.coalesce(F.sum(F.col("held") * F.col("price")), F.lit(0.0))).alias("capital"))
    own = targets.join(px, "ticker").where("price > 0").join(held, "ticker", "left").withColumn("held", F.coalesce("held", F.lit(0))).crossJoin(F.broadcast(worth))
    want = F.floor(F.abs("weight") * F.col("capital") / F.col("price") / lot) * lot
    change = F.when(F.col("weight") >= 0, want - F.col("held")).otherwise(-F.greatest("held", F.lit(0)))
    out = own.withColumn("change", change.cast("long")).where("change != 0")
    return out.select("ticker", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), F.abs("change").alias("quantity"), "price")


def accepted(quantity: Column, side: Column, price: Column, cash: Column, lot: int = LOT) -> Column:
    """Why an order is refused before it is placed; null if it is not."""
    return F.when(quantity <= 0, "quantity").when(quantity % lot != 0, "lot").when((side == "buy") & (quantity * F.coalesce(price, F.lit(0.0)) > cash), "cash")


def fill(orders: DataFrame, cash: float = 1_000_000.0, commission: float = 0.0003, least: float = 5.0, tax: float = 0.001, slippage: float = 0.001, lot: int = LOT) -> DataFrame:
    """(account, seq, ticker, status, quantity, price, commission, tax, cash, held, avg_cost) of orders (account, seq,
    ticker, side, quantity, price); cash, held and its mean cost are those after the order.

    Orders of an account are filled one after the other, as they share its cash: a fold over them, whose state is the
    cash and what is held. A purchase that costs too much is cut to whole lots; one of none, a sale of more than is
    held and an order without a price are rejected.
    """
    row = F.struct("seq", "ticker", "side", "quantity", "price")
    zero = F.struct(F.lit(cash).alias("cash"), F.create_map().cast(HELD).alias("held"), F.array().cast(f"array<{FILLS}>").alias("out"))

    def step(s, o):
        buys = o["side"] == "buy"
        px = F.round(o["price"] * F.when(buys, 1 + slippage).otherwise(1 - slippage), 3)
        mine = F.try_element_at(s["held"], o["ticker"])
        has, cost = F.coalesce(mine["q"], F.lit(0).cast("long")), F.coalesce(mine["c"], F.lit(0.0))
        fee = lambda q: F.greatest(q * px * commission, F.lit(least))
        fits = o["quantity"] * px + fee(o["quantity"]) <= s["cash"]
        cut = F.floor(s["cash"] / (px * (1 + commission)) / lot) * lot
        q = F.when(buys, F.when(fits, o["quantity"]).otherwise(F.greatest(cut, F.lit(0)))).otherwise(F.when(has >= o["quantity"], o["quantity"]).otherwise(0)).cast("long")
        q = F.when(F.coalesce(o["price"], F.lit(0.0)) == 0, F.lit(0).cast("long")).otherwise(q)
        done = q > 0
        paid = F.when(buys, 0.0).otherwise(q * px * tax)
        after = F.when(~done, s["cash"]).when(buys, s["cash"] - q * px - fee(q)).otherwise(s["cash"] + q * px - fee(q) - paid)
        now = F.when(buys, has + q).otherwise(has - q)
        mean = F.when(now <= 0, 0.0).when(buys & done, (cost * has + q * px) / now).otherwise(cost)
        rest = F.map_filter(s["held"], lambda k, v: k != o["ticker"])
        held = F.when(done, F.map_concat(rest, F.create_map(o["ticker"], F.struct(now.alias("q"), mean.alias("c"))))).otherwise(s["held"])
        line = F.struct(
            o["seq"].cast("long").alias("seq"), o["ticker"].alias("ticker"), F.when(done, "filled").otherwise("rejected").alias("status"), q.alias("quantity"), F.when(done, px).alias("price"),
            F.when(done, fee(q)).otherwise(0.0).alias("commission"), F.when(done, paid).otherwise(0.0).alias("tax"), after.alias("cash"),
            F.when(done, now).otherwise(has).alias("held"), F.when(done, mean).otherwise(cost).alias("avg_cost"),
        )
        return F.struct(after.alias("cash"), held.alias("held"), F.concat(s["out"], F.array(line)).alias("out"))

    g = orders.groupBy("account").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select("account", F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select("account", "o.*")


def positions_after(fills: DataFrame) -> DataFrame:
    """(account, ticker, quantity, avg_cost) of what the fills leave; a partial sale leaves the mean cost as it was."""
    last = fills.groupBy("account", "ticker").agg(F.max_by(F.struct("held", "avg_cost"), "seq").alias("l"))
    return last.select("account", "ticker", F.col("l.held").alias("quantity"), F.col("l.avg_cost").alias("avg_cost")).where("quantity > 0")


def open_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status").isin("submitted", "accepted"))


def cancel(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """orders (order_id, status) with those of ids cancelled that are still open."""
    j = orders.join(ids.select("order_id").distinct().withColumn("_c", F.lit(True)), "order_id", "left")
    gone = F.col("_c").isNotNull() & F.col("status").isin("submitted", "accepted")
    return j.withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status"))).drop("_c")
