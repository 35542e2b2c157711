"""DataFrame operators: filters, pricing, detail, summaries, rankings, choices, invoices."""
