"""A small source tree with planted facts: a copy across modules, a deep import, a spelling drift, a call chain, tests."""

FILES = {
    "src/billing/index.ts": "export { charge, refund } from './engine';\nexport { checkCard } from './checks';\n",
    "src/billing/engine.ts": """import { checkCard } from './checks';

// Computes the fee of a card payment
export function feeOf(amount: number, rate: number): number {
  if (amount <= 0) {
    return 0;
  }
  const base = amount * rate;
  return base > 100 ? base - 1 : base + 2;
}

export function charge(card: Card, amount: number): Receipt {
  checkCard(card, amount, 'charge');
  const fee = feeOf(amount, 0.03);
  return store.save({ amount: amount + fee, card });
}

export const refund = async (card: Card, amount: number) => {
  const fee = feeOf(amount, 0.01);
  return store.save({ amount: fee - amount, card });
};

export function summarizeBook(rows: Row[], year: number): number {
  let total = 0;
  for (const row of rows) {
    if (row.year === year && row.amount > 0) {
      total += row.amount;
    }
  }
  return total;
}
""",
    "src/billing/checks.ts": """export function checkCard(card: Card, amount: number, mode: string): boolean {
  if (!card || !card.number) {
    throw new Error('no card');
  }
  if (amount <= 0 || amount > 5000) {
    throw new Error('bad amount');
  }
  return mode === 'charge' ? card.active : true;
}
""",
    "src/orders/place.ts": """import { checkCard } from '../billing/checks';
import type { Card } from '../billing/types';

export function verifyOrderCard(c: Card, total: number, kind: string): boolean {
  if (!c || !c.digits) {
    throw new Error('missing');
  }
  if (total <= 10 || total > 900) {
    throw new Error('range');
  }
  return kind === 'order' ? c.open : true;
}

export function summariseBook(items: Row[], period: number): number {
  let sum = 0;
  let count = 0;
  for (const item of items) {
    if (item.period === period && item.value > 0 && count < 50) {
      sum += item.value;
      count += 1;
    }
  }
  return count > 0 ? sum : 0;
}

export class OrderDesk {
  private open = true;
  place(order: Order, card: Card) {
    verifyOrderCard(card, order.total, 'order');
    return checkCard(card, order.total, 'charge');
  }
}
""",
    "src/app/main.ts": """import { charge } from '../billing';
import { OrderDesk } from '../orders/place';

export function checkout(cart: Cart, card: Card) {
  const desk = new OrderDesk();
  desk.place(cart.order, card);
  return charge(card, cart.total);
}
""",
    "src/app/main.test.ts": "import { checkout } from './main';\n\nfunction t() { checkout({}, {}); }\n",
    "py/tools/__init__.py": "from .core import run\n\n__all__ = ['run']\n",
    "py/tools/core.py": '''"""Docs."""
import os
from ..base import helper


LIMIT = 3
_hidden = 1


def run(path, *, deep=False):
    # walks the folder tree
    def inner(x):
        return helper(x)

    return [inner(p) for p in os.listdir(path)]


class Walker:
    def step(self, node):
        return run(node.path)


def _private():
    return LIMIT
''',
    "py/base.py": "def helper(x):\n    return x\n",
    "py/broken.py": "def f(:\n",
    "go/srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/x/util"\n)\n\ntype Server struct { n int }\n\nfunc (s *Server) Serve(port int) error {\n\tfmt.Println(port)\n\treturn util.Listen(port)\n}\n\nfunc helper() {}\n',
    "java/src/main/java/com/acme/a/Cart.java": "package com.acme.a;\nimport com.acme.b.Store;\n\npublic class Cart {\n  private Store store;\n  public int total(int rate) {\n    return store.sum(rate);\n  }\n  void hidden() { total(1); }\n}\n",
    "java/src/main/java/com/acme/b/Store.java": "package com.acme.b;\n\npublic class Store {\n  public int sum(int rate) { return rate * 2; }\n}\n",
    "rs/lib.rs": "use crate::util::walk;\n\npub struct Node { n: u32 }\n\npub fn visit(n: &Node) -> u32 {\n    walk(n)\n}\n\nfn quiet() {}\n",
    "rb/cart.rb": "require_relative 'store'\n\nclass Cart\n  def total(rate)\n    sum(rate) if rate\n  end\n\n  private\n\n  def sum(rate)\n    rate * 2\n  end\nend\n",
    "php/Cart.php": "<?php\nuse Acme\\Store;\n\nclass Cart {\n  private function low($x) { return $x; }\n  public function total($rate, $tax = 1) {\n    return $this->low($rate);\n  }\n}\n",
    "c/list.c": '#include "list.h"\n\nstatic int grow(int n) { return n * 2; }\n\nint list_push(struct list *l, int v) {\n  return grow(v);\n}\n',
    "cs/Cart.cs": "using Acme.Store;\n\nnamespace Acme {\n  public class Cart {\n    public int Total(int rate) { return Sum(rate); }\n    int Sum(int rate) { return rate; }\n  }\n}\n",
    "kt/Cart.kt": "import acme.Store\n\nclass Cart {\n  fun total(rate: Int): Int = sum(rate)\n  private fun sum(rate: Int): Int { return rate }\n}\n",
    "swift/Cart.swift": "import Foundation\n\nstruct Cart {\n  func total(rate: Int) -> Int { return sum(rate) }\n  private func sum(_ rate: Int) -> Int { return rate }\n}\n",
    "dart/cart.dart": "import 'store.dart';\n\nclass Cart {\n  int total(int rate) { return _sum(rate); }\n  int _sum(int rate) { return rate; }\n}\n",
    "vue/View.vue": "<template>\n  <p/>\n</template>\n<script>\nimport { ship } from './x';\nexport function pay(a) {\n  return ship(a);\n}\n</script>\n",
    "cob/PAY.cbl": "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAYROLL.\n       DATA DIVISION.\n       COPY RATES.\n       PROCEDURE DIVISION USING EMP-REC.\n       MAIN-PARA.\n           PERFORM CALC-PAY THRU CALC-EXIT.\n           CALL 'TAXPROG' USING EMP-REC.\n           GO TO DONE-PARA.\n       CALC-PAY.\n           COMPUTE PAY = HOURS * 10.\n       CALC-EXIT.\n           EXIT.\n       DONE-PARA.\n           STOP RUN.\n",
    "node_modules/skip/index.ts": "export function no() {}\n",
    ".hidden/x.ts": "export function no() {}\n",
    "src/types.d.ts": "export type X = 1;\n",
}


def write(root) -> str:
    for path, text in FILES.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)
