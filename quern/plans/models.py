"""Models of the tables that the catalogue reads."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from quern.types import Double, Float, Int, Long


@dataclass
class Region:
    r_regionkey: Int
    r_name: str


@dataclass
class Nation:
    n_nationkey: Int
    n_name: str
    n_regionkey: Int


@dataclass
class Customer:
    c_custkey: Long
    c_name: str
    c_nationkey: Int
    c_acctbal: Double
    c_mktsegment: str


@dataclass
class Supplier:
    s_suppkey: Long
    s_name: str
    s_nationkey: Int
    s_acctbal: Double


@dataclass
class Part:
    p_partkey: Long
    p_name: str
    p_brand: str
    p_type: str
    p_size: Int
    p_retailprice: Double


@dataclass
class Order:
    o_orderkey: Long
    o_custkey: Long
    o_orderstatus: str
    o_totalprice: Double
    o_orderdate: datetime.datetime
    o_orderpriority: str


@dataclass
class Lineitem:
    l_orderkey: Long
    l_partkey: Long
    l_suppkey: Long
    l_linenumber: Int
    l_quantity: Double
    l_extendedprice: Double
    l_discount: Double
    l_tax: Double
    l_returnflag: str
    l_linestatus: str
    l_shipdate: datetime.datetime


@dataclass
class Event:
    event_id: Long
    ts: datetime.datetime
    user_id: Long
    event_type: str
    value: Double
    props: str


@dataclass
class Document:
    doc_id: Long
    text: str
    lang: str
    source: str
    n_chars: Long


@dataclass
class Label:
    doc_id: Long
    quality: Int
    toxic: Int


@dataclass
class Embedding:
    vec_id: Long
    embedding: list[Float]
    label: Int


@dataclass
class Turn:
    conv_id: Long
    turn: Long
    role: str
    text: str


TABLES = {
    "region": Region,
    "nation": Nation,
    "customer": Customer,
    "supplier": Supplier,
    "part": Part,
    "orders": Order,
    "lineitem": Lineitem,
    "events": Event,
    "documents": Document,
    "labels": Label,
    "embeddings": Embedding,
    "conversations": Turn,
}
