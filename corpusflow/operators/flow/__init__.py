"""Program-flow operators over ``flow_nodes`` / ``flow_edges`` / ``flow_guards`` tables."""
