"""Schemas of the sources, and the parameters of a review."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _I, _D, _F = T.StringType(), T.IntegerType(), T.DateType(), T.DoubleType()

LEDGER = _struct(
    src_row=_I, account=_S, account_name=_S, party=_S, debit=MONEY, credit=MONEY, entry_date=_D,
    party_tax_id=_S, doc_no=_S, doc_type=_S, description=_S, user_name=_S,
)
TRIAL_BALANCE = _struct(version=_S, src_row=_I, account=_S, name=_S, opening=MONEY, debits=MONEY, credits=MONEY, closing=MONEY)
DEBT_REGISTER = _struct(
    src_row=_I, label=_S, description=_S, balance=MONEY, pct_of_debt=_F, rate_type=_S, spread=_F, ea_client=_F,
    periods_per_year=_I, pay_type=_S, current_portion=MONEY, noncurrent_portion=MONEY, instalments_left=_I,
    maturity=_D, weighted_rate=_F,
)
OPENING = _struct(src_row=_I, aux_account=_S, tax_id=_S, party=_S, doc_date=_D, amount=MONEY, note=_S, cross_doc=_S)
CERTIFICATES = _struct(
    page=_S, bank=_S, number=_S, obligation_id=_S, doc_type=_S, cut_date=_D, principal=MONEY, later_repayment=MONEY,
    ea=_F, maturity=_D, note=_S,
)
PAYMENTS = _struct(obligation_id=_S, concept=_S, doc_no=_S, side=_S, bank_amount=MONEY, comment=_S)
CELLS = _struct(sheet=_S, row=_I, col=_I, value=_S)
SCHEDULE = _struct(
    id=_S, hoja=_S, tipo=_S, banco=_S, contrato=_S, tir=_F, tir_unidad=_S, param=T.MapType(_S, _S),
    filas=T.ArrayType(_struct(
        per=_F, fecha=_D, saldo_ini=_F, interes=_F, capital=_F, pago=_F, cuota=_F, tasa=_F, ibr=_F, puntos=_F,
        saldo_fin=_F, ca_saldo=_F,
    )),
)


@dataclass(frozen=True)
class Params:
    """Cut-off date and thresholds. The year's start and the next twelve months follow from the cut-off."""

    cutoff: dt.date = dt.date(1998, 6, 30)
    trivial: Decimal = Decimal("1000.00")
    interest_tolerance: float = 0.02
    analytic_tolerance: float = 0.10

    @property
    def year_start(self) -> dt.date:
        return self.cutoff.replace(month=1, day=1)

    @property
    def next_year(self) -> dt.date:
        """Twelve months after the cut-off, at the end of a shorter month."""
        try:
            return self.cutoff.replace(year=self.cutoff.year + 1)
        except ValueError:
            return self.cutoff.replace(year=self.cutoff.year + 1, day=28)


def check_schema(df, wanted: T.StructType):
    """`df` itself if it has the wanted columns and types in any order; otherwise an error that names the first miss."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in wanted.fields:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df
