"""Questions over the tables and the dashboard tables made from them."""
