"""A small Rust crate that the registered code queries run on."""

FILES = {
    "src/lib.rs": '''//! Events and their store.
pub mod store;
pub mod web;
use std::fmt;
pub use store::save as keep;

/// An event.
#[derive(Debug, Clone)]
pub struct Event { pub id: u64, pub kind: String, source_url: String }

pub enum Level { Low, High { by: u32 } }
pub const LIMIT: usize = 16;

impl fmt::Display for Event {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, "{}", self.id) }
}

pub fn parse(line: &str) -> Option<Event> {
    let parts = split(line);
    build(parts)
}

fn split(line: &str) -> Vec<String> { line.split(',').map(String::from).collect() }

fn build(parts: Vec<String>) -> Option<Event> {
    let id = parts.len() as u64;
    Some(Event { id, kind: String::new(), source_url: String::new() })
}

pub fn step(event: Event) -> Event {
    if event.kind == "fast" || event.kind == "slow" { return event; }
    event
}

pub fn pipe(line: &str) {
    let event = parse(line).unwrap();
    let next = step(event);
    store::save(next);
}

pub fn never_called(mode: &str) -> bool { mode == "on" || mode == "off" || mode == "auto" }

#[cfg(test)]
mod tests {
    use super::*;
    #[test]
    fn parses() { let e = parse("a,b"); helper(e); }
    fn helper(_: Option<Event>) {}
}
''',
    "src/store.rs": '''use crate::Event;
static mut COUNT: u32 = 0;
pub trait Store { fn put(&mut self, event: Event); fn flush(&self) {} }
pub struct Memory { events: Vec<Event>, home_path: String }
impl Store for Memory { fn put(&mut self, event: Event) { self.events.push(event); } }
pub fn save(event: Event) { let mut m = open(); m.put(event); }
fn open() -> Memory { Memory { events: Vec::new(), home_path: String::new() } }
''',
    "src/web.rs": '''pub fn list() {}
pub fn app() { Router::new().route("/events", get(list)); crate::pipe("x"); }
pub fn save() {}
''',
}
