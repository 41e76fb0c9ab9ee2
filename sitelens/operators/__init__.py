"""DataFrame operators: links, robots admission, crawl, dedup, discovery, locales."""
