"""Operators: every report, list, audit and change job as a function from DataFrames to DataFrames.

- ``balances``: the term-balance formula (gross fee, discounts, payments) for a whole population.
- ``reports``: outstanding lists and totals, class fee status, dashboard, receipts, statements, histories.
- ``students``: head-counts per class, lookup, search and directory.
- ``uniforms``: eligibility (as equi-joins), issue history, stock lists.
- ``lists``: ordered class, term, fee-default and staff lists.
- ``audits``: integrity checks of the reference's keys and one-row tables.
- ``changes``: batch change jobs with rejects (registrations, edits, deletes, inserts, restocks).
- ``stock_fold``: uniform issues against stock, an exact segmented fold that never gathers an item.
- ``numbering``: dense row numbers over a whole table.
"""
